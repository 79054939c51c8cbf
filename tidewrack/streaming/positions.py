"""Hourly vessel positions from a live stream.

Reports of vessels that the roster does not know are counted and cut before they take up any
state. The query keeps the last report (by event time) per vessel and clock hour, emits an hour
once the watermark has passed its end, and stores it unless that vessel-hour is already stored.
However late the first report of an hour comes, it is emitted then; an hour that was emitted stays
so for a time to live. Offsets, open hours and marks live in the checkpoint, so a restart resumes
them, and open hours can be read from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewrack.operators.effort import enrich_positions

HOURLY = (
    "mmsi string, recorded_at timestamp, lat double, lon double, source string,"
    " ship_name string, flag string, gear_type string, effort_hours double, day date"
)
POSITION = "lat double, lon double, name string"
OPEN = "struct<hour: long, at_us: long, lat: double, lon: double, name: string>"
STORES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: The name under which a query reports how many reports it saw and how many were off the roster.
ROSTER_METRIC = "roster"


# -- the hours ----------------------------------------------------------------------------------------


def hourly_positions(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Last report per vessel and hour of a batch of reports; on a stream, late first reports are lost.

    `closed_hours` is the streaming form that keeps them.
    """
    latest = F.max_by(F.struct("lat", "lon", "name"), F.struct("at_time", "lat", "lon"))
    return (
        reports.withWatermark("at_time", delay)
        .groupBy(F.window("at_time", "1 hour").alias("w"), "mmsi")
        .agg(latest.alias("last"))
        .select("mmsi", F.col("w.start").alias("recorded_at"), "last.lat", "last.lon", "last.name")
    )


class LastOfHours(StatefulProcessor):
    """State of a vessel: the last report of each open hour, and the hours emitted of late.

    One timer per vessel stands at the end of its earliest open hour, or where all its marks have
    had their time (`keep_ms`), so a batch costs a few state calls per vessel however many hours it brings.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getValueState("hours", f"open array<{OPEN}>, emitted array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.hours.get()
        open_, emitted = ({r[0]: tuple(r) for r in held[0]}, set(held[1])) if held else ({}, set())
        before = min(open_, default=None)
        for r in rows:
            if r.hour in emitted:
                continue
            new, old = (r.hour, r.at_us, r.lat, r.lon, r.name), open_.get(r.hour)
            if old is None or new[:4] > old[:4]:
                open_[r.hour] = new
        yield from self._settle(key[0], open_, emitted, timerValues.getCurrentWatermarkInMs(), before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.hours.get()
        if held is not None:
            open_, emitted = {r[0]: tuple(r) for r in held[0]}, set(held[1])
            yield from self._settle(key[0], open_, emitted, timerValues.getCurrentWatermarkInMs(), None)

    def _settle(self, mmsi: str, open_: dict, emitted: set, mark_ms: int, timed: int | None) -> Iterator[Row]:
        """Emit the hours that the watermark has passed, forget old marks, and set the next timer
        unless there is one for the open hour `timed`."""
        due = sorted(h for h in open_ if (h + 1) * HOUR_MS <= mark_ms)
        out = [open_.pop(h) for h in due]
        emitted = {h for h in emitted.union(due) if (h + 1) * HOUR_MS + self.keep_ms > mark_ms}
        if not open_ and not emitted:
            self.hours.clear()
        else:
            self.hours.update(([open_[h] for h in sorted(open_)], sorted(emitted)))
            # A timer fires once the watermark is past it.
            if not open_:
                self.handle.registerTimer((max(emitted) + 1) * HOUR_MS + self.keep_ms - 1)
            elif min(open_) != timed:
                self.handle.registerTimer((min(open_) + 1) * HOUR_MS - 1)
        for hour, _, lat, lon, name in out:
            yield Row(mmsi=mmsi, hour=hour, lat=lat, lon=lon, name=name)

    def close(self) -> None:
        pass


def closed_hours(
    reports: DataFrame, delay: str = "1 hour", keep: timedelta = timedelta(days=7), roster: DataFrame | None = None
) -> DataFrame:
    """(mmsi, recorded_at, lat, lon, name) of each vessel-hour of a stream, once, when it closes.

    With a roster, reports of other vessels are cut (see `on_roster`); they still move the time on.

    An hour closes when the watermark (newest report minus `delay`) reaches its end. Reports that
    come later still open an hour that has had none; it is emitted with the batch they come in. An
    emitted hour takes no more reports until `keep` after its end. Equal instants go by position.
    """
    # Without the watermark's own column Spark does not drop late rows before the state sees them.
    timed = reports.withWatermark("at_time", delay)
    timed = timed if roster is None else on_roster(timed, roster)
    rows = timed.select(
        "mmsi",
        F.floor(F.unix_millis("at_time") / HOUR_MS).alias("hour"),
        F.unix_micros("at_time").alias("at_us"),
        "lat", "lon", "name",
    )
    processor = LastOfHours(int(keep.total_seconds() * 1000))
    closed = rows.groupBy("mmsi").transformWithState(
        processor, f"mmsi string, hour long, {POSITION}", outputMode="append", timeMode="eventTime"
    )
    return closed.select("mmsi", F.timestamp_seconds(F.col("hour") * 3600).alias("recorded_at"), "lat", "lon", "name")


def open_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(mmsi, recorded_at, lat, lon, name) of the vessel-hours that a query's state holds unemitted.

    Reads the last committed batch; the query may be stopped or running.
    """
    state = spark.read.format("statestore").option("stateVarName", "hours").load(checkpoint)
    hours = state.select("key.mmsi", F.explode("value.open").alias("h"))
    return hours.select("mmsi", F.timestamp_seconds(F.col("h.hour") * 3600).alias("recorded_at"), "h.lat", "h.lon", "h.name")


# -- the roster ---------------------------------------------------------------------------------------


def on_roster(reports: DataFrame, roster: DataFrame) -> DataFrame:
    """Reports of roster vessels; how many were seen and how many cut is observed as ROSTER_METRIC."""
    known = roster.select("mmsi").distinct().withColumn("_known", F.lit(True))
    return (
        reports.join(known, "mmsi", "left")
        .observe(
            ROSTER_METRIC,
            F.count(F.lit(1)).alias("seen"),
            F.count(F.when(F.col("_known").isNull(), 1)).alias("off_roster"),
        )
        .where("_known")
        .drop("_known")
    )


def off_roster(positions: DataFrame, roster: DataFrame) -> DataFrame:
    """Positions of vessels the roster does not know."""
    return positions.join(roster.select("mmsi"), "mmsi", "left_anti")


def roster_counts(query: StreamingQuery) -> tuple[int, int]:
    """(reports seen, reports off the roster) of a query's recent progress."""
    rows = [p.observedMetrics[ROSTER_METRIC] for p in query.recentProgress if ROSTER_METRIC in p.observedMetrics]
    return sum(r.seen for r in rows), sum(r.off_roster for r in rows)


# -- the stored table ---------------------------------------------------------------------------------


def _stored(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    try:
        return spark.read.schema(f"{HOURLY}, batch long").option("basePath", path).parquet(*folders)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{HOURLY}, batch long")


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The stored hours with the batch that wrote them; empty before the first one."""
    return _stored(spark, path, [path])


def read_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The stored hours of some days; the folders of other days are not listed."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    folders = []
    for day in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        if folder.getFileSystem(hadoop).exists(folder):
            folders.append(f"{path}/day={day}")
    return _stored(spark, path, folders) if folders else spark.createDataFrame([], f"{HOURLY}, batch long")


def _insert_new(spark: SparkSession, rows: DataFrame, path: str, batch_id: int) -> None:
    """Add completed rows whose vessel-hour no other batch has stored, under day and batch."""
    rows = rows.withColumn("day", F.to_date("recorded_at")).persist()
    try:
        days = [r.day for r in rows.select("day").distinct().collect()]  # bounded by the calendar
        if not days:
            return
        others = read_days(spark, path, days).where(F.col("batch") != batch_id)
        fresh = rows.join(others.select("mmsi", "recorded_at"), ["mmsi", "recorded_at"], "left_anti")
        writer = fresh.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    finally:
        rows.unpersist()


def store_new_hours(path: str, roster: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: completes positions and stores the vessel-hours not yet there.

    The roster is read again for each batch. A batch owns one folder in each day it touches, which
    it overwrites, and is compared with the other batches of those days only, so running it again
    after a failure changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _insert_new(spark, enrich_positions(batch, roster(spark)), path, batch_id)

    return write


def flush_open_hours(
    spark: SparkSession, path: str, checkpoint: str, roster: Callable[[SparkSession], DataFrame]
) -> None:
    """Store the open hours of a stopped query as they are; hours that are stored stay.

    If the query is resumed, a flushed hour is not stored again when it closes.
    """
    rows = enrich_positions(open_hours(spark, checkpoint), roster(spark))
    # Batches of the stream count up from 0, flushes down from -1.
    _insert_new(spark, rows, path, -time.time_ns())


# -- running it ---------------------------------------------------------------------------------------


def start_hourly(
    reports: DataFrame,
    path: str,
    checkpoint: str,
    roster: Callable[[SparkSession], DataFrame],
    delay: str = "1 hour",
    once: bool = False,
    keep: timedelta = timedelta(days=7),
) -> StreamingQuery:
    """Start (or resume) the hourly table; `once` drains what has arrived and stops.

    The vessels that are let in are those of the roster at the start: see `follow_hourly`. The state
    needs the RocksDB store, which is set for this query only.
    """
    spark = reports.sparkSession
    writer = (
        closed_hours(reports, delay, keep, roster(spark))
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store_new_hours(path, roster))
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")
    before = spark.conf.get(STORES)
    spark.conf.set(STORES, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(STORES, before)


def follow_hourly(
    start: Callable[[], StreamingQuery],
    refresh: timedelta = timedelta(minutes=30),
    until: Callable[[], bool] = lambda: False,
) -> None:
    """Run a query and resume it from its checkpoint whenever its roster is `refresh` old.

    `start` starts or resumes it (and so reads the roster anew). Returns when `until` holds or the
    query ends by itself; what the query raises is raised here.
    """
    while True:
        query, since = start(), time.monotonic()
        while not query.awaitTermination(0.2 if refresh < timedelta(minutes=1) else 5):
            done = until()
            if done or time.monotonic() - since >= refresh.total_seconds():
                query.stop()
                break
        else:
            return
        if done:
            return
