"""Fishing effort: vessel-hours, release seeds, arrivals, fleet roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.constants import AIS_LIVE, GFW_FISHING, WEIGHT_FLOOR
from tidewrack.functions.effort import gear_weight, release_scale
from tidewrack.functions.timeline import utc_day

ROSTER_FIELDS = ("flag", "gear_type", "vessel_type", "ship_name")


def collapse_cells(positions: DataFrame) -> DataFrame:
    """One row per vessel-hour: total effort, other columns of the strongest cell.

    Equal efforts go to the first cell seen (lowest `ordinal`, of any type with an order).
    """
    keys = ["mmsi", "recorded_at"]
    rest = [c for c in positions.columns if c not in (*keys, "effort_hours", "ordinal")]
    effort = F.coalesce(F.col("effort_hours"), F.lit(0.0))
    order = F.struct(-effort, F.col("ordinal"))
    return (
        positions.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("best"), F.sum(effort).alias("effort_hours"))
        .select(*keys, "best.*", "effort_hours")
    )


def release_seeds(positions: DataFrame) -> DataFrame:
    """Weighted release points per (day, hour, rounded position) over all days at once."""
    day = utc_day(F.col("recorded_at"))
    return (
        positions.filter(F.col("effort_hours") > 0)
        .groupBy(
            day.alias("day"),
            F.hour("recorded_at").alias("hour"),
            F.round("lat", 3).alias("lat"),
            F.round("lon", 3).alias("lon"),
        )
        .agg(F.sum(F.col("effort_hours") * gear_weight(F.col("gear_type"))).alias("effort"))
        .withColumn("weight", F.col("effort") * release_scale(F.col("day")))
        .filter(F.col("weight") > WEIGHT_FLOOR)
        .drop("effort")
    )


def arrival_rollup(arrivals: DataFrame) -> DataFrame:
    """Hourly arrivals to drift_daily rows: landing day is release day plus whole days."""
    landing = F.date_add("release_day", F.floor(F.col("hour") / 24).cast("int"))
    return arrivals.groupBy(
        "release_day", landing.alias("day"), F.col("segment_id").alias("coastal_segment_id")
    ).agg(F.sum("drift_index").alias("drift_index"))


def mass_balance(seeds: DataFrame, drift: DataFrame) -> DataFrame:
    """Per release day: weight released, weight stranded, segment-days reached."""
    released = seeds.groupBy(F.col("day").alias("release_day")).agg(
        F.sum("weight").alias("released")
    )
    stranded = drift.groupBy("release_day").agg(
        F.sum("drift_index").alias("stranded"), F.count("*").alias("segment_days")
    )
    return released.join(stranded, "release_day", "left").select(
        "release_day",
        "released",
        F.coalesce("stranded", F.lit(0.0)).alias("stranded"),
        F.coalesce("segment_days", F.lit(0)).alias("segment_days"),
    )


def last_known(positions: DataFrame) -> DataFrame:
    """Roster of vessels with effort: per field the latest known value, blank means none.

    Fields are independent; an empty latest value does not fall back to an older one.
    Equal instants are settled by the larger value.
    """
    fields = [c for c in ROSTER_FIELDS if c in positions.columns]

    def latest(name: str):
        known = F.col(name).isNotNull()
        ranking = F.when(known, F.struct("recorded_at", name))
        return F.nullif(F.max_by(F.when(known, F.col(name)), ranking), F.lit("")).alias(name)

    return (
        positions.filter(F.col("source") == GFW_FISHING)
        .groupBy("mmsi")
        .agg(*(latest(name) for name in fields))
    )


def enrich_positions(positions: DataFrame, roster: DataFrame) -> DataFrame:
    """Live hourly positions of known vessels, completed from the roster.

    `positions(mmsi, recorded_at, lat, lon, name)` may be a stream; off-roster vessels drop.
    """
    return positions.join(roster, "mmsi").select(
        "mmsi",
        "recorded_at",
        "lat",
        "lon",
        F.lit(AIS_LIVE).alias("source"),
        F.coalesce(F.col("name"), F.col("ship_name")).alias("ship_name"),
        *(c for c in ("flag", "gear_type", "vessel_type") if c in roster.columns),
        F.lit(None).cast("double").alias("effort_hours"),
    )
