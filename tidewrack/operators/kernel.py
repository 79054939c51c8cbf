"""Distance-weighted means of gridded values on coast segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.constants import KERNEL_KM_PER_DEG, REACH_CUTOFF, REACH_KM


def longitude_scale(segments: DataFrame) -> Column:
    """Cosine of the mean segment latitude, as a scalar subquery (1 without segments)."""
    return segments.agg(
        F.coalesce(F.cos(F.radians(F.avg("center_lat"))), F.lit(1.0)).alias("scale")
    ).scalar()


def kernel_means(
    segments: DataFrame, values: DataFrame, names: Sequence[str], reach_km: float = REACH_KM
) -> DataFrame:
    """(center_lat, center_lon, day, *names): weighted means over the cells with a row that day.

    Gaussian weights, zero beyond 3 reaches. Works on distinct centres. The tile is as wide
    as the cut-off at the mean latitude, so a pair in range is always in adjacent tiles;
    cells, the side bounded by the lattice, are repeated into the 3 x 3 neighbourhood with a
    month of their values in one row. All cells of a centre meet it in its own tile, so its
    sums are complete before the shuffle and only (centre, day) rows travel.
    """
    cutoff = REACH_CUTOFF * reach_km
    span = cutoff / KERNEL_KM_PER_DEG * (1.0 + 1e-9)
    scale = longitude_scale(segments)
    centers = (
        segments.select("center_lat", "center_lon")
        .distinct()
        .withColumn("scale", scale)
        .withColumn("tile_row", F.floor(F.col("center_lat") / span).cast("int"))
        .withColumn("tile_col", F.floor(F.col("center_lon") * F.col("scale") / span).cast("int"))
    )
    around = F.sequence(F.lit(-1), F.lit(1))
    # At most 31 days per array.
    monthly = values.groupBy("lat", "lon", F.trunc("day", "month").alias("month")).agg(
        F.collect_list(F.struct("day", *names)).alias("days")
    )
    placed = (
        monthly.withColumn("row_shift", F.explode(around))
        .withColumn("col_shift", F.explode(around))
        .select(
            "lat",
            "lon",
            "days",
            (F.floor(F.col("lat") / span).cast("int") + F.col("row_shift")).alias("tile_row"),
            (F.floor(F.col("lon") * scale / span).cast("int") + F.col("col_shift")).alias(
                "tile_col"
            ),
        )
    )
    distance = F.hypot(
        (F.col("center_lat") - F.col("lat")) * KERNEL_KM_PER_DEG,
        (F.col("center_lon") - F.col("lon")) * KERNEL_KM_PER_DEG * F.col("scale"),
    )
    ratio = F.col("distance") / reach_km
    return (
        centers.join(placed, ["tile_row", "tile_col"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= cutoff)
        .select(
            "center_lat",
            "center_lon",
            F.exp(F.lit(-0.5) * ratio * ratio).alias("weight"),
            F.inline("days"),
        )
        .groupBy("center_lat", "center_lon", "day")
        .agg(*((F.sum(F.col("weight") * F.col(n)) / F.sum("weight")).alias(n) for n in names))
    )


def kernel_interpolate(
    segments: DataFrame, values: DataFrame, names: Sequence[str], reach_km: float = REACH_KM
) -> DataFrame:
    """(segment_id, day, *names) for segments with a cell in reach that day.

    Segments without one are absent; a dense result fills them with 0.
    """
    means = kernel_means(segments, values, names, reach_km)
    return segments.select("segment_id", "center_lat", "center_lon").join(
        means, ["center_lat", "center_lon"]
    ).select("segment_id", "day", *names)
