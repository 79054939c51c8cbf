"""Instants, days, slots and buckets (UTC throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.constants import CHUNK_EPOCH, FORECAST, OBSERVED, SEA_LAG_DAYS

# Steps that complete an ISO text to seconds and offset, and the shape it must then have.
DATE_ONLY = r"^(\d{4}-\d{2}-\d{2})$"
TO_MINUTES = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)"
NO_OFFSET = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$"
COMPLETE = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2}))$"
)


def utc_instant(text: Column) -> Column:
    """Strict ISO text to an instant; text without an offset is UTC, bad text is null.

    One chain of replacements: the text is only read once, whatever its shape.
    """
    value = F.regexp_replace(F.trim(text), DATE_ONLY, "$1T00:00:00Z")
    value = F.regexp_replace(value, TO_MINUTES, "$1:00")
    value = F.regexp_replace(value, NO_OFFSET, "$1Z")
    return F.regexp_extract(value, COMPLETE, 1).try_cast("timestamp")


def event_window(text: Column) -> Column:
    """`a` or `a/b` to struct(recorded_at, half_width_hours); null when unusable.

    A window that ends on a bare date includes that whole day.
    """
    first = F.trim(F.substring_index(text, "/", 1))
    last = F.trim(F.regexp_extract(text, r"^[^/]*/(.*)$", 1))
    start = utc_instant(first)
    stated_end = F.when(last == "", start).otherwise(utc_instant(last))
    closing = F.when(last == "", first).otherwise(last)
    start_us = F.unix_micros(start)
    end_us = F.unix_micros(stated_end) + F.when(
        F.length(closing) == 10, F.lit(86_400_000_000)
    ).otherwise(F.lit(0))
    usable = start.isNotNull() & stated_end.isNotNull() & (stated_end >= start)
    middle = F.timestamp_micros(start_us + F.floor((end_us - start_us) / 2))
    half_width = (end_us - start_us) / F.lit(7_200_000_000.0)
    return F.when(
        usable, F.struct(middle.alias("recorded_at"), half_width.alias("half_width_hours"))
    )


def event_slot(day: Column) -> Column:
    """0-based day of a leap year, so 29 February is always slot 59."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(day), F.dayofmonth(day))) - 1


def chunk_bucket(day: Column, days_per_chunk: Column | int) -> Column:
    """First day of the chunk holding `day`, floored from the fixed epoch."""
    size = days_per_chunk if isinstance(days_per_chunk, Column) else F.lit(days_per_chunk)
    epoch = F.lit(CHUNK_EPOCH).cast("date")
    chunks = F.floor(F.datediff(day, epoch) / size)
    return F.date_add(epoch, (chunks * size).cast("int"))


def floor_hour(instant: Column) -> Column:
    return F.date_trunc("hour", instant)


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def hours_between(start: Column, instant: Column) -> Column:
    """Whole hours from `start` to `instant`, floored (negative before the start)."""
    seconds = F.unix_micros(instant.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(seconds / F.lit(3_600_000_000.0)).cast("long")


def risk_source(day: Column, as_of: Column) -> Column:
    return F.when(day > F.date_sub(as_of, SEA_LAG_DAYS), F.lit(FORECAST)).otherwise(
        F.lit(OBSERVED)
    )
