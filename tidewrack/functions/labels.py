"""Text labels and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_label(label: Column) -> Column:
    """No-break spaces become spaces, runs of spaces become one, ends are trimmed."""
    spaced = F.regexp_replace(F.translate(label, "\u00a0", " "), " +", " ")
    return F.regexp_replace(spaced, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def coordinate_text(value: Column) -> Column:
    return F.format_string("%.5f", value)


def identity_hash(payload: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the payload text."""
    return F.substring(F.sha2(payload, 256), 1, 32)


def readable(text: Column, parsed: Column) -> Column:
    """`parsed`, or an error where it is null because `text` is not JSON (a null text is no error).

    Only texts that gave nothing are looked at a second time.
    """
    unreadable = parsed.isNull() & text.isNotNull() & F.try_parse_json(text).isNull()
    message = F.concat(F.lit("not JSON: "), F.substring(text, 1, 60))
    return F.when(unreadable, F.raise_error(message)).otherwise(parsed)
