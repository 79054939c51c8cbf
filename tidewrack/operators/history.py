"""Event history on segments: decayed persistence and leave-one-year-out climatology.

All operators take `observed(segment_id, day, records)`, already counted per segment and
day, so a segment's group never holds more rows than the calendar has days.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.constants import (
    HALF_LIFE_DAYS,
    ISSUE_LAG_DAYS,
    WINDOW_HALF_SLOTS,
    YEAR_SLOTS,
)
from tidewrack.functions.scoring import logit, poisson_chance
from tidewrack.functions.timeline import event_slot

# Any fixed day works: it only keeps the running sums near 1.
DECAY_EPOCH = "2000-01-01"


def persistence(observed: DataFrame, spine: DataFrame) -> DataFrame:
    """`spine` rows (unique segment_id, day) plus the decayed count of earlier records.

    Records up to the issue lag before the day count with a half life. With the weights
    written relative to a fixed epoch this is a running sum per segment, so a whole span of
    days costs one shuffle instead of a join of days with records.
    """
    epoch = F.lit(DECAY_EPOCH).cast("date")
    extra = [c for c in spine.columns if c not in ("segment_id", "day")]
    asked = spine.select(
        "segment_id",
        F.datediff(F.date_sub("day", ISSUE_LAG_DAYS), epoch).alias("at_day"),
        F.lit(0).alias("is_record"),
        F.lit(0.0).alias("mass"),
        F.struct("day", *extra).alias("row"),
    )
    age = F.datediff("day", epoch)
    seen = observed.select(
        "segment_id",
        age.alias("at_day"),
        F.lit(1).alias("is_record"),
        (F.col("records") * F.pow(F.lit(2.0), age / HALF_LIFE_DAYS)).alias("mass"),
        F.lit(None).cast(asked.schema["row"].dataType).alias("row"),
    )
    # Asked days sort before records of the same day: only strictly earlier ones count.
    running = Window.partitionBy("segment_id").orderBy("at_day", "is_record").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    decayed = F.sum("mass").over(running) * F.pow(F.lit(2.0), -F.col("at_day") / HALF_LIFE_DAYS)
    return (
        asked.unionByName(seen)
        .withColumn("persistence", decayed)
        .filter(F.col("is_record") == 0)
        .select("segment_id", "row.*", "persistence")
    )


def gathered(observed: DataFrame, start: Column, end: Column) -> DataFrame:
    """`observed` as far as `persistence` of the days in [start, end] needs it: the records before all
    of their cutoffs in one row per segment, with the weight they have there; none after the last cutoff."""
    first = F.date_sub(start, ISSUE_LAG_DAYS + 1)
    day = F.greatest(F.col("day"), first)
    weight = F.pow(F.lit(2.0), F.datediff("day", day) / HALF_LIFE_DAYS)
    return (
        observed.where(F.col("day") < F.date_sub(end, ISSUE_LAG_DAYS))
        .select("segment_id", day.alias("day"), (F.col("records") * weight).alias("records"))
        .groupBy("segment_id", "day")
        .agg(F.sum("records").alias("records"))
    )


def record_mass(observed: DataFrame) -> DataFrame:
    """(segment_id, mass): records weighted relative to the epoch, so that masses of spans add up."""
    age = F.datediff("day", F.lit(DECAY_EPOCH).cast("date"))
    return observed.groupBy("segment_id").agg(
        F.sum(F.col("records") * F.pow(F.lit(2.0), age / HALF_LIFE_DAYS)).alias("mass")
    )


def advance_mass(mass: DataFrame, new_records: DataFrame) -> DataFrame:
    """The mass of a span and of the records that follow it (or come late)."""
    both = mass.select("segment_id", "mass").unionByName(record_mass(new_records))
    return both.groupBy("segment_id").agg(F.sum("mass").alias("mass"))


def persistence_from_mass(mass: DataFrame, segments: DataFrame, day: date) -> DataFrame:
    """(segment_id, day, persistence) of one day, from the mass of all records before its cutoff."""
    age = (day - timedelta(days=ISSUE_LAG_DAYS) - date.fromisoformat(DECAY_EPOCH)).days
    return segments.select("segment_id").join(mass, "segment_id", "left").select(
        "segment_id",
        F.lit(day).alias("day"),
        (F.coalesce("mass", F.lit(0.0)) * 2.0 ** (-age / HALF_LIFE_DAYS)).alias("persistence"),
    )


def climatology_counts(observed: DataFrame) -> DataFrame:
    """Records per (segment_id, year, slot)."""
    return observed.groupBy(
        "segment_id", F.year("day").alias("year"), event_slot(F.col("day")).alias("slot")
    ).agg(F.sum("records").alias("records"))


def in_windows_of(observed: DataFrame, slots: DataFrame) -> DataFrame:
    """`observed` as far as the window sums of `slots(slot)` need it; both slot tables are bounded by the year."""
    around = F.sequence(F.col("slot") - WINDOW_HALF_SLOTS, F.col("slot") + WINDOW_HALF_SLOTS)
    near = slots.select(F.explode(around).alias("near")).select(
        F.pmod("near", F.lit(YEAR_SLOTS)).cast("int").alias("near")
    ).distinct()
    return observed.join(F.broadcast(near), event_slot(F.col("day")) == F.col("near"), "left_semi")


def circular_window_sum(counts: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Moving +-15 slot sums that wrap inside the same year; optionally only of the rows of `slots`.

    `slots(slot)` has at most one row per slot of the year, so it is broadcast.
    """
    return _moving(counts, ["segment_id", "year"], slots)


def all_years_sum(counts: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """(segment_id, slot, records): `circular_window_sum` added up over the years."""
    return _moving(counts, ["segment_id"], slots)


def _moving(counts: DataFrame, keys: list[str], slots: DataFrame | None) -> DataFrame:
    """A record raises the sums of its window where that opens and lowers them where it closes.

    The counts of a key meet in one row, which has at most one of each slot, and are opened into a
    few steps each; the slots between two steps are made from the running sum last, row by row, so
    that no task sorts or holds the sums of all slots.
    """
    n = F.col("records").cast("long")
    once = counts.groupBy(*keys, "slot").agg(F.sum(n).alias("n")) if "year" not in keys else counts.withColumn("n", n)
    met = once.where("slot IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct("slot", "n")).alias("own"))

    def step(at: Column, by: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), by.alias("by"))

    def steps(own: Column) -> Column:
        opens, closes = own["slot"] - WINDOW_HALF_SLOTS, own["slot"] + (WINDOW_HALF_SLOTS + 1)
        return F.array(
            step(F.greatest(opens, F.lit(0)), own["n"]),
            F.when(closes < YEAR_SLOTS, step(closes, -own["n"])),
            # What reaches over an end of the year opens at the other end.
            F.when(opens < 0, step(opens + YEAR_SLOTS, own["n"])),
            F.when(closes > YEAR_SLOTS, step(F.lit(0), own["n"])),
            F.when(closes > YEAR_SLOTS, step(closes - YEAR_SLOTS, -own["n"])),
        )

    # The rows of a key are where the grouping has put them: the windows need no further shuffle.
    along = Window.partitionBy(*keys).orderBy("at")
    running = F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.coalesce(F.lead("at").over(along), F.lit(YEAR_SLOTS))
    moved = (
        met.select(*keys, F.inline(F.array_compact(F.flatten(F.transform("own", steps)))))
        .select(*keys, "at", until.alias("until"), running.alias("records"))
        .where((F.col("until") > F.col("at")) & (F.col("records") > 0))
        .select(*keys, F.explode(F.sequence("at", F.col("until") - 1)).alias("slot"), "records")
    )
    return moved if slots is None else moved.join(F.broadcast(slots), "slot", "left_semi").select(*moved.columns)


def leave_one_year_out(windowed: DataFrame, days: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(segment_id, day, records): window sums of every year but the day's own.

    The sum over all years less the own year's row, so the work is that of the result. `days` is a
    calendar (bounded by its span) and is broadcast; absent pairs are 0. `every` is the
    `all_years_sum` of the same counts, where they are at hand.
    """
    asked = days.select("day", F.year("day").alias("year"), event_slot(F.col("day")).alias("slot"))
    if every is None:
        every = windowed.groupBy("segment_id", "slot").agg(F.sum("records").alias("records"))
    every = every.withColumnRenamed("records", "every")
    others = F.col("every") - F.coalesce(F.col("records"), F.lit(0))
    return (
        every.join(F.broadcast(asked), "slot")
        .join(windowed, ["segment_id", "slot", "year"], "left")
        .select("segment_id", "day", others.alias("records"))
        .filter(F.col("records") > 0)
    )


def with_seasonal(spine: DataFrame, held_out: DataFrame, observed: DataFrame) -> DataFrame:
    """`spine` plus the seasonal chance; a year with no record is not taken off the divisor."""
    # One small array: the calendar years that have a record.
    years = observed.agg(F.collect_set(F.year("day")).alias("years")).scalar()
    own = F.array_contains(F.col("_years"), F.year("day"))
    divisor = F.size("_years") - F.when(own, 1).otherwise(0)
    return (
        spine.join(held_out, ["segment_id", "day"], "left")
        .withColumn("_years", years)
        .withColumn(
            "seasonal", poisson_chance(F.coalesce(F.col("records"), F.lit(0)), divisor)
        )
        .drop("records", "_years")
    )


def seasonal_baseline(observed: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: mean logit of the all-years chance over every segment and slot.

    Segment-slots without a record all share one value, so only the others are computed.
    """
    years = observed.agg(F.count_distinct(F.year("day")).alias("n")).scalar()
    totals = all_years_sum(climatology_counts(observed)).withColumn("_years", years)
    busy = totals.agg(
        F.coalesce(F.sum(logit(poisson_chance(F.col("records"), F.col("_years")))), F.lit(0.0)).alias("s"),
        F.count("*").alias("n"),
    )
    slots = (segments.agg((F.count("*") * YEAR_SLOTS).alias("n"))).scalar()
    quiet = logit(poisson_chance(F.lit(0), F.col("_years")))
    return (
        busy.withColumn("_years", years)
        .withColumn("_slots", slots)
        .select(
            ((F.col("s") + (F.col("_slots") - F.col("n")) * quiet) / F.col("_slots")).alias(
                "seasonal_baseline"
            )
        )
    )
