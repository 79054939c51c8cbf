"""Session set-up, and where intermediate results that cut lineage are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewrack")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Test data is small: keep every core busy where few bytes fan out into much work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return use_utc(spark)


def use_utc(spark: SparkSession) -> SparkSession:
    """Days and hours are UTC; plans built afterwards resolve their casts in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A local session without one gets a temporary folder that goes with the process; on a cluster
    executors would not share it, so there the setting is required.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidewrack-", dir="/tmp")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        folder = context.getCheckpointDir()
    return folder


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def release_settled(spark: SparkSession) -> None:
    """Delete what `settled` and `new_folder` have made; call it when their results are no longer read."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and read that: lineage ends there.

    Later jobs neither recompute nor reorder it, survive lost executors, and read only the
    columns they need.
    """
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """`df` dealt out over the cluster by `keys`, for few bytes that fan out into much work.

    The number of partitions, at least `least`, is given, as adaptive execution would put small ones
    together again.
    """
    spark = df.sparkSession
    return df.repartition(max(range_partitions(spark), spark.sparkContext.defaultParallelism, least), *keys)


def range_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
