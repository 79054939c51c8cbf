"""The decayed record mass of every segment, stored as of a day and advanced by new records only."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import ISSUE_LAG_DAYS
from tidewrack.operators.history import advance_mass, persistence_from_mass, record_mass

MASS = "segment_id long, mass double"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def stored_through(spark: SparkSession, path: str) -> list[date]:
    """The days before which a stored mass holds all records, ascending; whole versions only."""
    store, folder = _folder(spark, path)
    if not store.exists(folder):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory()]
    return sorted(
        date.fromisoformat(n.removeprefix("through="))
        for n in names
        if n.startswith("through=") and store.exists(done(f"{path}/{n}/_SUCCESS"))
    )


def read_mass(spark: SparkSession, path: str, through: date) -> DataFrame:
    return spark.read.schema(MASS).parquet(f"{path}/through={through}")


def mass_before(spark: SparkSession, path: str, observed: DataFrame, cutoff: date) -> DataFrame:
    """(segment_id, mass) of all records before `cutoff`, stored; reads only the records since the
    latest stored day.

    A version is a folder of its own, written whole from an earlier one, so writing it again after a
    failure gives the same. Records that come for days a version already covers: see `forget_from`.
    """
    versions = [d for d in stored_through(spark, path) if d <= cutoff]
    if versions and versions[-1] == cutoff:
        return read_mass(spark, path, cutoff)
    fresh = observed.where(F.col("day") < F.lit(cutoff))
    if versions:
        fresh = fresh.where(F.col("day") >= F.lit(versions[-1]))
        mass = advance_mass(read_mass(spark, path, versions[-1]), fresh)
    else:
        mass = record_mass(fresh)
    mass.select(F.col("segment_id").cast("long").alias("segment_id"), "mass").write.mode("overwrite").parquet(
        f"{path}/through={cutoff}"
    )
    return read_mass(spark, path, cutoff)


def daily_persistence(spark: SparkSession, path: str, observed: DataFrame, segments: DataFrame, day: date) -> DataFrame:
    """(segment_id, day, persistence) of one day, advancing the stored mass to it."""
    cutoff = day - timedelta(days=ISSUE_LAG_DAYS)
    return persistence_from_mass(mass_before(spark, path, observed, cutoff), segments, day)


def forget_from(spark: SparkSession, path: str, day: date) -> None:
    """Drop the versions that cover `day`, for which records have come late.

    The next `mass_before` starts from the version before it and reads the records since; dropping
    twice, or only some before a failure, does no harm.
    """
    store, _ = _folder(spark, path)
    for through in stored_through(spark, path):
        if through > day:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/through={through}"), True)
