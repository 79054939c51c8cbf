"""Which days are planned, pending, covered or missing, as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import (
    ARCHIVE_CHUNK_DAYS,
    BACKFILL_DAYS,
    FORECAST_DAYS,
    JOB_STATES,
    KINDS,
)
from tidewrack.functions.timeline import chunk_bucket

KIND_SCHEMA = (
    "kind string, first string, last string, lag int, ahead int, chunk int, volatile int,"
    " rolling boolean"
)


def kinds(spark: SparkSession) -> DataFrame:
    """The kinds of work (a fixed handful of rows), with their limits as dates."""
    rows = spark.createDataFrame([tuple(k) for k in KINDS], KIND_SCHEMA)
    return rows.withColumn("first", F.col("first").cast("date")).withColumn(
        "last", F.col("last").cast("date")
    )


def _horizon() -> Column:
    return F.least(F.col("last"), F.date_add("as_of", F.col("ahead") - F.col("lag")))


def _clamped_days(start: Column, end: Column) -> Column:
    """Days of the span inside the kind's limits; an empty array when there are none."""
    low = F.greatest(start, F.col("first"))
    high = F.least(end, _horizon())
    empty = F.array().cast("array<date>")
    return F.when(low <= high, F.sequence(F.least(low, high), high)).otherwise(empty)


def rolling_spans(calendar: DataFrame) -> DataFrame:
    """The span planned on each day: some days back, the forecast days ahead."""
    return calendar.select(
        "as_of",
        F.date_sub("as_of", BACKFILL_DAYS).alias("start"),
        F.date_add("as_of", FORECAST_DAYS).alias("end"),
    )


def plan_buckets(kind_table: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, as_of, bucket): what planning on each `as_of` wants over [start, end].

    A rolling kind only ever wants the day itself.
    """
    # The kinds are a fixed handful of rows carried by every span as one array.
    listed = kind_table.agg(F.collect_list(F.struct(*kind_table.columns)).alias("k")).scalar()
    paired = spans.withColumn("_kinds", listed).select(
        "as_of", "start", "end", F.inline("_kinds")
    )
    days = F.when(F.col("rolling"), F.array("as_of")).otherwise(
        F.transform(
            _clamped_days(F.col("start"), F.col("end")),
            lambda day: chunk_bucket(day, F.col("chunk")),
        )
    )
    return paired.select(
        "kind", "as_of", F.explode(F.array_distinct(days)).alias("bucket")
    )


def pending_buckets(
    plan: DataFrame, ledger: DataFrame, kind_table: DataFrame, redo: bool = False
) -> DataFrame:
    """(kind, bucket, reason) for one planning day: new ones and finished ones to run again.

    Without `redo`, finished buckets re-open inside the kind's volatile window; with it,
    every finished bucket between the first and the last planned one does.
    """
    stored = ledger.select("kind", F.col("day").alias("bucket"), "status")
    fresh = (
        plan.select("kind", "bucket")
        .join(stored, ["kind", "bucket"], "left_anti")
        .withColumn("reason", F.lit("new"))
    )
    finished = stored.filter(F.col("status").isin("done", "failed"))
    # Ranges and kinds: one row per kind.
    if redo:
        limits = plan.groupBy("kind").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    else:
        today = plan.agg(F.max("as_of").alias("t")).scalar()
        limits = kind_table.filter(F.col("volatile") > 0).select(
            "kind",
            F.date_sub(today, F.col("volatile")).alias("lo"),
            F.lit("9999-12-31").cast("date").alias("hi"),
        )
    reopened = (
        finished.join(F.broadcast(limits), "kind")
        .filter(F.col("bucket").between(F.col("lo"), F.col("hi")))
        .select("kind", "bucket", F.lit("reopened").alias("reason"))
    )
    return fresh.unionByName(reopened)


def bucket_days(buckets: DataFrame, kind_table: DataFrame) -> DataFrame:
    """(kind, as_of, bucket, day): the days each bucket covers when run on `as_of`."""
    covers = F.when(F.col("rolling"), F.array("bucket")).otherwise(
        _clamped_days(F.col("bucket"), F.date_add("bucket", F.col("chunk") - 1))
    )
    # One row per kind.
    return buckets.join(F.broadcast(kind_table), "kind").select(
        "kind", "as_of", "bucket", F.explode(covers).alias("day")
    )


def ingested_days(kind_table: DataFrame, calendar: DataFrame) -> DataFrame:
    """(kind, day) ingested when every day of the calendar plans and then runs its buckets.

    A bucket runs when first planned and on every later day inside its volatile window, and
    the last run covers the most; a bucket without that window is run once.
    """
    planned = plan_buckets(kind_table.filter(~F.col("rolling")), rolling_spans(calendar))
    first_run = planned.groupBy("kind", "bucket").agg(F.min("as_of").alias("first_run"))
    # At most `volatile` further days per bucket.
    later = (
        first_run.join(F.broadcast(kind_table.select("kind", "volatile")), "kind")
        .filter(F.date_add("bucket", F.col("volatile")) > F.col("first_run"))
        .select(
            "kind",
            "bucket",
            F.explode(
                F.sequence("first_run", F.date_add("bucket", F.col("volatile")))
            ).alias("as_of"),
        )
        .join(calendar, "as_of", "left_semi")
    )
    last_run = (
        first_run.select("kind", "bucket", F.col("first_run").alias("as_of"))
        .unionByName(later.select("kind", "bucket", "as_of"))
        .groupBy("kind", "bucket")
        .agg(F.max("as_of").alias("as_of"))
    )
    return bucket_days(last_run, kind_table).select("kind", "day").distinct()


def wanted_days(kind_table: DataFrame, calendar: DataFrame) -> DataFrame:
    """(kind, day) that a gap-free run over the calendar has to cover."""
    edges = calendar.agg(F.struct(F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))).scalar()
    low = F.greatest(F.date_sub("_edges.lo", BACKFILL_DAYS), F.col("first"))
    high = F.least(F.date_sub("_edges.hi", F.col("lag")), F.col("last"))
    return (
        kind_table.filter(~F.col("rolling"))
        .withColumn("_edges", edges)
        .filter(low <= high)
        .select("kind", F.explode(F.sequence(low, high)).alias("day"))
    )


def missing_days(wanted: DataFrame, ingested: DataFrame) -> DataFrame:
    return wanted.join(ingested, ["kind", "day"], "left_anti")


def coverage_gaps(kind_table: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per kind: days wanted, days covered, share covered and the first gap."""
    marked = wanted_days(kind_table, calendar).join(
        ingested_days(kind_table, calendar).withColumn("_in", F.lit(1)), ["kind", "day"], "left"
    )
    return (
        marked.groupBy("kind")
        .agg(
            F.count("*").alias("wanted"),
            F.count("_in").alias("covered"),
            F.min(F.when(F.col("_in").isNull(), F.col("day"))).alias("first_gap"),
        )
        .withColumn("share", F.col("covered") / F.col("wanted"))
    )


def coverage_status(ledger: DataFrame) -> DataFrame:
    """Per kind: rows in each state, first and last day."""
    counts = [F.count_if(F.col("status") == state).alias(state) for state in JOB_STATES]
    return ledger.groupBy("kind").agg(
        *counts, F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def waiting_on_inputs(ledger: DataFrame, now: Column) -> DataFrame:
    return (
        ledger.filter((F.col("status") == "pending") & (F.col("not_before") > now))
        .groupBy("kind")
        .agg(F.count("*").alias("waiting"), F.max("deferrals").alias("deepest"))
    )


def latest_failures(ledger: DataFrame, count: int = 5) -> DataFrame:
    """The last failures with the first line of their error ('-' when there is none)."""
    line = F.get(F.split("error", "\n"), F.lit(0))
    return (
        ledger.filter(F.col("status") == "failed")
        .orderBy(F.desc("day"), "kind")
        .limit(count)
        .select("kind", "day", F.coalesce(F.nullif(line, F.lit("")), F.lit("-")).alias("error"))
    )


def complete_buckets(days: DataFrame, chunk: int = ARCHIVE_CHUNK_DAYS) -> DataFrame:
    """(kind, bucket) whose every day is complete; `days(kind, day, complete)`, unique days."""
    return (
        days.groupBy("kind", chunk_bucket(F.col("day"), chunk).alias("bucket"))
        .agg(F.count_if("complete").alias("complete_days"))
        .filter(F.col("complete_days") == chunk)
    )
