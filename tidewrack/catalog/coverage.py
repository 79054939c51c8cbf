"""Coverage planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.registry import query
from tidewrack.operators import coverage


def _plan(spark, folder):
    spans = coverage.rolling_spans(inputs.calendar(spark, folder))
    return coverage.plan_buckets(coverage.kinds(spark), spans)


@query("c1_plan_buckets", "SELECT kind, as_of, bucket FROM fx_plan")
def planned(spark, folder):
    return _plan(spark, folder)


PENDING = """SELECT p.kind, p.bucket, 'new' AS reason
   FROM (SELECT DISTINCT kind, bucket, as_of FROM fx_plan WHERE as_of = (SELECT max(as_of) FROM fx_calendar)) p
   LEFT JOIN fx_ledger l ON l.kind = p.kind AND l.day = p.bucket WHERE l.kind IS NULL
   UNION ALL """


def _today_plan(spark, folder):
    plan = _plan(spark, folder)
    calendar = inputs.calendar(spark, folder)
    return plan.filter(F.col("as_of") == calendar.agg(F.max("as_of")).scalar())


@query(
    "c2_pending_buckets",
    PENDING + """SELECT l.kind, l.day, 'reopened' FROM fx_ledger l JOIN fx_kind k USING (kind)
       WHERE l.status IN ('done', 'failed') AND volatile_days > 0
         AND l.day >= (SELECT max(as_of) FROM fx_calendar) - volatile_days""",
)
def pending(spark, folder):
    return coverage.pending_buckets(
        _today_plan(spark, folder), inputs.ledger(spark, folder), coverage.kinds(spark)
    )


@query(
    "c2_pending_redo",
    PENDING + """SELECT l.kind, l.day, 'reopened' FROM fx_ledger l
       JOIN (SELECT kind, min(bucket) AS lo, max(bucket) AS hi FROM fx_plan
             WHERE as_of = (SELECT max(as_of) FROM fx_calendar) GROUP BY 1) p USING (kind)
       WHERE l.status IN ('done', 'failed') AND l.day BETWEEN lo AND hi""",
)
def redo(spark, folder):
    return coverage.pending_buckets(
        _today_plan(spark, folder), inputs.ledger(spark, folder), coverage.kinds(spark), redo=True
    )


@query(
    "c3_bucket_days",
    """SELECT kind, as_of, bucket, day FROM (
         SELECT *, bucket + cast(o AS int) AS day FROM (
           SELECT p.kind, p.as_of, p.bucket, k.* EXCLUDE (kind), unnest(range(chunk_days)) AS o
           FROM fx_plan p JOIN fx_kind k ON k.kind = p.kind))
       WHERE rolling OR (day >= first_ok AND day <= least(last_ok, as_of + ahead_days - lag_days))""",
)
def covered_days(spark, folder):
    return coverage.bucket_days(_plan(spark, folder), coverage.kinds(spark))


INGESTED = """SELECT DISTINCT kind, day FROM (SELECT r.kind, r.as_of, k.* EXCLUDE (kind),
      r.bucket + cast(unnest(range(k.chunk_days)) AS int) AS day
  FROM (SELECT p.kind, p.bucket, c.as_of FROM (SELECT kind, bucket, min(as_of) AS t0 FROM fx_plan GROUP BY 1, 2) p
        JOIN fx_kind k ON k.kind = p.kind AND NOT k.rolling
        JOIN fx_calendar c ON c.as_of = p.t0 OR (c.as_of > p.t0 AND p.bucket >= c.as_of - k.volatile_days
                                                 AND k.volatile_days > 0)) r
  JOIN fx_kind k ON k.kind = r.kind)
  WHERE day >= first_ok AND day <= least(last_ok, as_of + ahead_days - lag_days)"""
WANTED = """SELECT kind, cast(unnest(generate_series(
    cast(greatest((SELECT min(as_of) FROM fx_calendar) - 14, first_ok) AS timestamp),
    cast(least((SELECT max(as_of) FROM fx_calendar) - lag_days, last_ok) AS timestamp), INTERVAL 1 DAY)) AS date) AS day
  FROM fx_kind WHERE NOT rolling"""


@query(
    "c4_coverage_gaps",
    f"""WITH ingested AS ({INGESTED}), wanted AS ({WANTED})
        SELECT w.kind, count(*) AS wanted, count(i.day) AS covered,
          min(CASE WHEN i.day IS NULL THEN w.day END) AS first_gap,
          round(count(i.day) / count(*), 6) AS share
        FROM wanted w LEFT JOIN ingested i ON i.kind = w.kind AND i.day = w.day GROUP BY 1""",
)
def gaps(spark, folder):
    rows = coverage.coverage_gaps(coverage.kinds(spark), inputs.calendar(spark, folder))
    return rows.withColumn("share", F.round("share", 6))


@query(
    "u3_missing_days",
    f"""WITH wanted AS ({WANTED}) SELECT kind, day FROM wanted
        EXCEPT SELECT kind, day FROM fx_ledger WHERE status = 'done'""",
)
def missing(spark, folder):
    """Days wanted of every kind that the ledger does not hold as done."""
    wanted = coverage.wanted_days(coverage.kinds(spark), inputs.calendar(spark, folder))
    done = inputs.ledger(spark, folder).filter(F.col("status") == "done").select("kind", "day")
    return coverage.missing_days(wanted, done)


@query(
    "a9_coverage_status",
    """SELECT kind, count(*) FILTER (WHERE status = 'pending') AS pending,
         count(*) FILTER (WHERE status = 'running') AS running,
         count(*) FILTER (WHERE status = 'done') AS done,
         count(*) FILTER (WHERE status = 'failed') AS failed,
         min(day) AS first_day, max(day) AS last_day FROM fx_ledger GROUP BY 1""",
)
def status(spark, folder):
    return coverage.coverage_status(inputs.ledger(spark, folder))


@query(
    "a9_waiting_on_inputs",
    """SELECT kind, count(*) AS waiting, max(deferrals) AS deepest FROM fx_ledger
       WHERE status = 'pending' AND not_before > timestamp '2024-03-01' GROUP BY 1""",
)
def waiting(spark, folder):
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    return coverage.waiting_on_inputs(inputs.ledger(spark, folder), now)


@query(
    "t2_latest_failures",
    """SELECT kind, day, split_part(error, chr(10), 1) AS error FROM fx_ledger
       WHERE status = 'failed' ORDER BY day DESC, kind LIMIT 5""",
)
def failures(spark, folder):
    return coverage.latest_failures(inputs.ledger(spark, folder))


@query(
    "a15_complete_buckets",
    """SELECT kind, bucket, complete_days FROM (
         SELECT kind, date '2020-01-06' + cast(floor((day - date '2020-01-06') / 14e0) * 14 AS int) AS bucket,
           count(*) FILTER (WHERE complete) AS complete_days
         FROM (SELECT event_type AS kind, cast(ts AS date) AS day, max(value) > 60 AS complete FROM events GROUP BY 1, 2)
         GROUP BY 1, 2)
       WHERE complete_days = 14""",
)
def complete(spark, folder):
    """A day of a kind of event is complete if one of its values is over 60."""
    days = (
        inputs.table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
        .agg((F.max("value") > 60).alias("complete"))
    )
    return coverage.complete_buckets(days)
