"""The coast raster, stored under the content of its coastline and brought up to date by what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import (
    KM_PER_LAT_DEG,
    KM_PER_LON_DEG,
    RASTER_COLUMNS,
    RASTER_ROWS,
    RASTER_STEP_DEG,
    REGION,
    SNAP_RADIUS_KM,
)
from tidewrack.operators.nearest import coast_raster, nearest_nodes
from tidewrack.session import settled

POINTS = "segment_id long, lat double, lon double"
RASTER = "node_row int, node_col int, segment_id long, distance_km double"


def _store(spark: SparkSession, path: str):
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new, new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _prints(points: DataFrame) -> DataFrame:
    """(segment_id, print): one number per segment that changes with any of its points."""
    each = F.xxhash64("segment_id", "lat", "lon").cast("decimal(38,0)")
    return points.groupBy("segment_id").agg(F.sum(each).alias("print"), F.count("*").alias("points"))


def fingerprint(points: DataFrame, radius_km: float) -> str:
    """A name for a coastline: equal for the same points in any order."""
    each = F.xxhash64("segment_id", "print", "points").cast("decimal(38,0)")
    total, count = _prints(points).agg(F.coalesce(F.sum(each), F.lit(0)), F.count("*")).first()
    return f"{count}-{int(total) % (1 << 64):016x}-{radius_km:g}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions by age, the newest first."""
    new, store = _store(spark, path)
    if not store.exists(new(path)):
        return []
    found = [s for s in store.listStatus(new(path)) if not s.getPath().getName().startswith("_")]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: -s.getModificationTime())]


def nodes_around(points: DataFrame, radius_km: float) -> DataFrame:
    """(node_row, node_col) of every node that one of the points may reach."""
    half_lat = radius_km / KM_PER_LAT_DEG
    half_lon = radius_km / F.greatest(F.lit(1.0), KM_PER_LON_DEG * F.cos(F.radians("lat")))

    def span(value, half, origin: float, count: int):
        low = F.greatest(F.floor((value - half - origin) / RASTER_STEP_DEG), F.lit(0))
        high = F.least(F.ceil((value + half - origin) / RASTER_STEP_DEG), F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))

    rows = span(F.col("lat"), F.lit(half_lat), REGION.min_lat, RASTER_ROWS)
    columns = span(F.col("lon"), half_lon, REGION.min_lon, RASTER_COLUMNS)
    return (
        points.select(F.explode(rows).alias("row"), columns.alias("columns"))
        .select("row", F.explode("columns").alias("column"))
        .select(F.col("row").cast("int").alias("node_row"), F.col("column").cast("int").alias("node_col"))
        .distinct()
    )


def changed_points(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new points of the segments that came, went or were altered."""
    old, new = _prints(before), _prints(after)
    both = old.join(new.withColumnsRenamed({"print": "p", "points": "n"}), "segment_id", "full_outer")
    same = F.col("print").eqNullSafe(F.col("p")) & F.col("points").eqNullSafe(F.col("n"))
    changed = settled(both.where(~same).select("segment_id"))
    return before.unionByName(after).join(changed, "segment_id", "left_semi")


def updated_raster(raster: DataFrame, before: DataFrame, after: DataFrame, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """(the raster of the coastline `after`, the nodes that were searched again), from that of `before`.

    A node can change only if a changed segment had or has a point within the radius of it.
    """
    touched = settled(nodes_around(changed_points(before, after), radius_km))
    key = ["node_row", "node_col"]
    return raster.join(touched, key, "left_anti").unionByName(nearest_nodes(touched, after, radius_km)), touched


def stored_raster(
    spark: SparkSession, path: str, segment_points: DataFrame, radius_km: float = SNAP_RADIUS_KM
) -> DataFrame:
    """The raster of a coastline, from `path` if it is there, else made from the newest version there is.

    Versions are named by the content of their coastline, so a changed one is never read as another.
    One is written beside the others and renamed when it is whole; the newest three stay.
    """
    points = segment_points.select(
        F.col("segment_id").cast("long").alias("segment_id"), "lat", "lon"
    )
    name = fingerprint(points, radius_km)
    new, store = _store(spark, path)
    versions = _versions(spark, path)
    if name not in versions:
        usable = [v for v in versions if v.endswith(f"-{radius_km:g}")]
        points = settled(points)
        if usable:
            old = f"{path}/{usable[0]}"
            before, raster = spark.read.schema(POINTS).parquet(f"{old}/points"), spark.read.schema(RASTER).parquet(f"{old}/raster")
            raster = updated_raster(raster, before, points, radius_km)[0]
        else:
            raster = coast_raster(points, radius_km)
        making = f"{path}/_making-{uuid.uuid4().hex}"
        points.write.parquet(f"{making}/points")
        raster.select("node_row", "node_col", F.col("segment_id").cast("long").alias("segment_id"), "distance_km").coalesce(
            8
        ).write.parquet(f"{making}/raster")
        if not store.rename(new(making), new(f"{path}/{name}")):
            store.delete(new(making), True)  # another job made it meanwhile
        for old_name in _versions(spark, path)[3:]:
            store.delete(new(f"{path}/{old_name}"), True)
    return spark.read.schema(RASTER).parquet(f"{path}/{name}/raster")
