"""Daily sea state per cell and recent drift per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.constants import DRIFT_WINDOW_DAYS
from tidewrack.functions.timeline import utc_day

SEA_VALUES = ("swell_m", "wave_m", "period_s", "east_m", "north_m")


def daily_sea_state(condition: DataFrame) -> DataFrame:
    """Daily means per cell over the hours that have a wave height; unknown means are 0."""
    wave = F.col("wave_height_m")
    heading = F.radians(F.col("wave_direction_deg") + 180.0)
    means = {
        "swell_m": F.avg("swell_height_m"),
        "wave_m": F.avg(wave),
        "period_s": F.avg("wave_period_s"),
        "east_m": F.avg(wave * F.sin(heading)),
        "north_m": F.avg(wave * F.cos(heading)),
    }
    return (
        condition.filter(wave.isNotNull())
        .groupBy(utc_day(F.col("valid_at")).alias("day"), "lat", "lon")
        .agg(*(F.coalesce(mean, F.lit(0.0)).alias(name) for name, mean in means.items()))
    )


def drift_recent(drift: DataFrame, window_days: int = DRIFT_WINDOW_DAYS) -> DataFrame:
    """(segment_id, day, drift_index): landings of the day and the days just before it."""
    landed = drift.groupBy(F.col("coastal_segment_id").alias("segment_id"), "day").agg(
        F.sum("drift_index").alias("drift_index")
    )
    return (
        landed.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(window_days))))
        .groupBy("segment_id", F.date_add("day", F.col("ahead")).alias("day"))
        .agg(F.sum("drift_index").alias("drift_index"))
    )


def densify_on_segments(segments: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Every segment with its value, 0 when it has none; unknown segment ids are ignored."""
    return segments.select("segment_id").join(
        values.select("segment_id", name), "segment_id", "left"
    ).withColumn(name, F.coalesce(name, F.lit(0.0)))
