"""Stored tables: schemas, half-open time scans, and writes that touch only some days."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import MEASURES, SIGNALS
from tidewrack.operators.merging import merge_upsert
from tidewrack.session import settled

#: Folders of replacements in a table: being written, and decided. Spark reads neither.
UNDECIDED, DECIDED, SWAPPED = "_writing-", "_replace-", "_emptied"
_PATH = "array<struct<lon: double, lat: double>>"

# table -> (conflict key, DDL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "coastal_segment": (
        ("external_id",),
        "segment_id bigint, external_id string, center_lat double, center_lon double,"
        f" length_km double, orientation_deg double, path {_PATH}",
    ),
    "condition": (
        ("valid_at", "lat", "lon"),
        "valid_at timestamp, lat double, lon double, forecast boolean, "
        + ", ".join(f"{m} double" for m in MEASURES),
    ),
    "vessel_position": (
        ("mmsi", "recorded_at"),
        "recorded_at timestamp, source string, mmsi string, lat double, lon double,"
        " ship_name string, flag string, gear_type string, vessel_type string,"
        " effort_hours double",
    ),
    "stranding": (
        ("source", "external_id"),
        "external_id string, source string, recorded_at timestamp, lat double, lon double,"
        " species_scientific string, species_common string, individual_count int,"
        " coordinate_uncertainty_m double, time_uncertainty_hours double,"
        " location_precision string",
    ),
    "drift_daily": (
        ("release_day", "day", "coastal_segment_id"),
        "release_day date, day date, coastal_segment_id bigint, drift_index double",
    ),
    "segment_risk": (
        ("day", "segment_id"),
        "day date, segment_id bigint, source string, probability double, seasonal double, "
        + ", ".join(f"{s} double" for s in SIGNALS),
    ),
    "job": (
        ("kind", "day"),
        "kind string, day date, status string, attempts int, deferrals int, error string,"
        " not_before timestamp, started_at timestamp, finished_at timestamp",
    ),
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table with its fixed schema; nothing is inferred."""
    return spark.read.schema(TABLES[name][1]).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def replace_days(spark: SparkSession, name: str, path: str, rows: DataFrame, start: str, end: str) -> None:
    """Make the days [start, end] of a stored table, partitioned by `day`, be exactly `rows`.

    All or nothing: the new rows are written beside the table first, with the span they replace;
    from the moment their folder has its final name the replacement holds. Only then are the days
    of the table swapped, which `finish_replacements` does again after a failure: readers call it
    (see `read_days_of`) and so never see a mixture. Only the partitions of the span are written or
    deleted. `rows` may read the table itself. Rows of other days are an error.
    """
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    fresh = settled(rows.select(*spark.createDataFrame([], TABLES[name][1]).columns))
    if not fresh.filter(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise ValueError(f"rows outside {start}..{end}")
    finish_replacements(spark, path)
    stage_replacement(spark, path, fresh, start, end)
    finish_replacements(spark, path)


def _store(spark: SparkSession, path: str):
    new = spark._jvm.org.apache.hadoop.fs.Path
    return new, new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage_replacement(spark: SparkSession, path: str, rows: DataFrame, start: str, end: str) -> None:
    """Write the rows of a replacement beside the table; renaming their folder decides that it holds."""
    new, store = _store(spark, path)
    token = uuid.uuid4().hex
    rows.write.partitionBy("day").parquet(f"{path}/{UNDECIDED}{token}")
    store.rename(new(f"{path}/{UNDECIDED}{token}"), new(f"{path}/{DECIDED}{start}_{end}_{token}"))


def finish_replacements(spark: SparkSession, path: str) -> None:
    """Carry out what has been decided: each day's folder is renamed into the table.

    Every step can be done again: a day whose new folder is gone has been swapped, and a day of the
    span without a new folder is empty from then on.
    """
    new, store = _store(spark, path)
    if not store.exists(new(path)):
        return
    for status in store.listStatus(new(path)):
        label = status.getPath().getName()
        if not label.startswith(DECIDED):
            continue
        start, end, _ = label.removeprefix(DECIDED).split("_")
        folder = f"{path}/{label}"
        swapped = new(f"{folder}/{SWAPPED}")
        own = {s.getPath().getName() for s in store.listStatus(new(folder)) if s.getPath().getName().startswith("day=")}
        if not store.exists(swapped):
            # Days that get no rows go first, while the folder still shows which days do.
            for old in store.listStatus(new(path)):
                day = old.getPath().getName()
                if day.startswith("day=") and start <= day.removeprefix("day=") <= end and day not in own:
                    store.delete(old.getPath(), True)
            store.create(swapped).close()
        for day in sorted(own):
            store.delete(new(f"{path}/{day}"), True)
            store.rename(new(f"{folder}/{day}"), new(f"{path}/{day}"))
        store.delete(new(folder), True)


def read_days_of(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table partitioned by `day`, after decided replacements are carried out.

    Folders of replacements, decided or not, are hidden from Spark's readers by their names.
    """
    finish_replacements(spark, path)
    return read_table(spark, name, path)


def upsert_days(
    spark: SparkSession, name: str, path: str, updates: DataFrame, overwrite: bool, order: Sequence[str] | None = None
) -> None:
    """Merge `updates` into a stored table, partitioned by `day`: only the days they touch are rewritten."""
    keys = TABLES[name][0]
    fresh = settled(updates)
    days = [r.day for r in fresh.select("day").distinct().collect()]  # bounded by the calendar
    if not days:
        return
    try:
        stored = read_table(spark, name, path).filter(F.col("day").isin(days))
        merged = settled(merge_upsert(stored, fresh, list(keys), overwrite, order=order))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        empty = spark.createDataFrame([], TABLES[name][1])
        merged = settled(merge_upsert(empty, fresh, list(keys), overwrite, order=order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def scan_span(df: DataFrame, column: str, start: Column | str, end: Column | str) -> DataFrame:
    """Rows with start <= column < end; literals of the column's own type reach the scan."""
    kind = df.schema[column].dataType
    low = F.lit(start).cast(kind) if isinstance(start, str) else start
    high = F.lit(end).cast(kind) if isinstance(end, str) else end
    return df.filter((F.col(column) >= low) & (F.col(column) < high))
