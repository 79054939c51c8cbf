"""Streaming queries: each one drains a stream over the event table and reads its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.landed import frames
from tidewrack.catalog.registry import query
from tidewrack.operators.effort import enrich_positions, last_known
from tidewrack.session import new_folder
from tidewrack.sources.positions import parse_position_reports
from tidewrack.streaming.positions import off_roster, open_hours, read_hourly, roster_counts, start_hourly


def _event_stream(spark, folder):
    return spark.readStream.schema(inputs.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(folder)


def _reports(events):
    """Position reports straight from events; watermarks need instants."""
    return events.select(
        F.col("user_id").cast("string").alias("mmsi"),
        F.col("ts").cast("timestamp").alias("at_time"),
        F.expr("42e0 + (event_id * 7919 % 9500) / 1000e0").alias("lat"),
        F.expr("-6e0 + (event_id * 104729 % 15500) / 1000e0").alias("lon"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("LIVE "), F.col("event_id").cast("string"))).alias("name"),
    )


def _fleet(session, folder):
    return last_known(inputs.vessels(session, folder))


def _run(spark, folder, reports, roster):
    """The drained query and the folder that holds its table and checkpoint."""
    target = new_folder(spark, "hourly")
    query_ = start_hourly(reports, f"{target}/table", f"{target}/checkpoint", roster, once=True)
    query_.awaitTermination()
    return query_, target


def _drain(spark, folder, reports):
    target = _run(spark, folder, reports, lambda session: _fleet(session, folder))[1]
    return read_hourly(spark, f"{target}/table")


LATEST = """(SELECT mmsi, date_trunc('hour', at_time) AS recorded_at, arg_max(lat, (at_time, lat, lon)) AS lat,
    arg_max({name}, (at_time, lat, lon)) AS name
  FROM {rows} GROUP BY 1, 2)"""
# Hours whose end the watermark (newest report minus one hour) has passed.
CLOSED = "recorded_at + to_hours(1) <= (SELECT max(at_time) FROM {rows}) - to_hours(1)"
RAW = """(SELECT cast(user_id AS varchar) AS mmsi, ts AS at_time, 42e0 + (event_id * 7919 % 9500) / 1000e0 AS lat,
    -6e0 + (event_id * 104729 % 15500) / 1000e0 AS lon,
    CASE WHEN event_id % 3 <> 0 THEN 'LIVE ' || cast(event_id AS varchar) ELSE '' END AS name FROM events)"""
FRAMES = """(SELECT cast(user_id AS varchar) AS mmsi, date_trunc('second', ts) AS at_time,
    42e0 + (event_id * 7919 % 9500) / 1000e0 AS lat, -6e0 + (event_id * 104729 % 15500) / 1000e0 AS lon,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'BOAT ' || cast(user_id AS varchar) END AS name
  FROM events WHERE event_type NOT IN ('error', 'signup'))"""


def _hourly_sql(rows):
    return f"""SELECT p.mmsi, p.recorded_at, round(p.lat, 6) AS lat,
        coalesce(nullif(p.name, ''), r.ship_name) AS ship_name, r.flag, 'ais_live' AS source
      FROM {LATEST.format(rows=rows, name='name')} p JOIN fx_roster r USING (mmsi)
      WHERE {CLOSED.format(rows=rows)}"""


def _shown(rows):
    return rows.select(
        "mmsi", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), r6("lat"),
        "ship_name", "flag", "source",
    )


@query("r1_r5_hourly_positions", _hourly_sql(RAW))
def hourly(spark, folder):
    return _shown(_drain(spark, folder, _reports(_event_stream(spark, folder))))


@query("r1_r5_hourly_from_frames", _hourly_sql(FRAMES))
def hourly_from_frames(spark, folder):
    """The same from raw frames: parsed, filtered and aggregated on the stream."""
    reports = parse_position_reports(frames(_event_stream(spark, folder)))
    return _shown(_drain(spark, folder, reports.drop("event_id")))


@query(
    "j6_enrich_positions",
    """SELECT e.event_id, r.mmsi, e.recorded_at, coalesce(e.name, r.ship_name) AS ship_name, r.flag, r.gear_type,
         'ais_live' AS source
       FROM (SELECT event_id, cast(user_id AS varchar) AS mmsi, ts AS recorded_at,
               CASE WHEN event_id % 3 <> 0 THEN 'LIVE ' || cast(event_id AS varchar) END AS name FROM events) e
       JOIN fx_roster r USING (mmsi)""",
)
def enriched(spark, folder):
    reports = _reports(inputs.table(spark, folder, "events")).withColumnRenamed(
        "at_time", "recorded_at"
    )
    roster = last_known(inputs.vessels(spark, folder))
    rows = enrich_positions(reports, roster)
    # The position identifies the event it came from.
    events = inputs.table(spark, folder, "events").select(
        "event_id", F.expr("42e0 + (event_id * 7919 % 9500) / 1000e0").alias("lat"),
        F.expr("-6e0 + (event_id * 104729 % 15500) / 1000e0").alias("lon"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
    )
    return rows.join(events, ["recorded_at", "lat", "lon"]).select(
        "event_id", "mmsi", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        "ship_name", "flag", "gear_type", "source",
    )


BUSY = "(SELECT mmsi FROM fx_vessel WHERE source = 'gfw_fishing' AND effort_hours > 2)"


def _busy(spark, folder):
    """A roster of the vessels that once fished for more than two hours."""
    return last_known(inputs.vessels(spark, folder).filter(F.col("effort_hours") > 2))


@query(
    "r4_off_roster",
    f"""SELECT cast(user_id AS varchar) AS mmsi, count(*) AS reports FROM events
       WHERE cast(user_id AS varchar) NOT IN {BUSY} GROUP BY 1""",
)
def unknown_vessels(spark, folder):
    """Reports of vessels that a roster of the busy ones does not know."""
    unknown = off_roster(_reports(inputs.table(spark, folder, "events")), _busy(spark, folder))
    return unknown.groupBy("mmsi").agg(F.count("*").alias("reports"))


@query(
    "r4_roster_counts",
    f"""SELECT count(*) AS seen, count(*) FILTER (WHERE cast(user_id AS varchar) NOT IN {BUSY}) AS off_roster
        FROM events""",
)
def roster_metric(spark, folder):
    """Reports seen and cut before the state, as the stream itself counts them."""
    query_, _ = _run(spark, folder, _reports(_event_stream(spark, folder)), lambda session: _busy(session, folder))
    return spark.createDataFrame([roster_counts(query_)], "seen long, off_roster long")


@query(
    "r5_open_hours",
    f"""SELECT p.mmsi, p.recorded_at, round(p.lat, 6) AS lat, nullif(p.name, '') AS name
        FROM {LATEST.format(rows=RAW, name='name')} p JOIN fx_roster r USING (mmsi)
        WHERE NOT {CLOSED.format(rows=RAW)}""",
)
def still_open(spark, folder):
    """Hours that are in the state when the stream is drained."""
    _, target = _run(spark, folder, _reports(_event_stream(spark, folder)), lambda session: _fleet(session, folder))
    return open_hours(spark, f"{target}/checkpoint").select(
        "mmsi", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), r6("lat"), "name"
    )


# Every seventh report comes last, the others in two halves of the month.
LANDING = "CASE WHEN event_id % 7 = 0 THEN 2 WHEN ts < timestamp '2024-01-16 00:00:00' THEN 0 ELSE 1 END"


@query(
    "r3_late_first_reports",
    f"""WITH report AS (
          SELECT cast(user_id AS varchar) AS mmsi, ts AS at_time, date_trunc('hour', ts) AS recorded_at,
                 42e0 + (event_id * 7919 % 9500) / 1000e0 AS lat, -6e0 + (event_id * 104729 % 15500) / 1000e0 AS lon,
                 {LANDING} AS landing FROM events
        ), passed AS (  -- the watermark that holds in each batch; the last one has no reports
          SELECT batch, max(at_time) - to_hours(1) AS mark FROM report JOIN (VALUES (1), (2), (3)) b(batch)
            ON landing < batch GROUP BY batch
        ), first AS (
          SELECT mmsi, recorded_at, min(landing) AS landing FROM report GROUP BY 1, 2
        ), emitted AS (
          SELECT f.mmsi, f.recorded_at, min(p.batch) AS batch FROM first f JOIN passed p
            ON p.batch >= f.landing AND p.mark >= f.recorded_at + to_hours(1) GROUP BY 1, 2
        )
        SELECT mmsi, recorded_at, round(arg_max(lat, (at_time, lat, lon)), 6) AS lat
        FROM emitted e JOIN report r USING (mmsi, recorded_at) JOIN fx_roster USING (mmsi)
        WHERE r.landing <= e.batch GROUP BY 1, 2""",
)
def late_first_reports(spark, folder):
    """Hours of a stream of which a part arrives weeks late: stored once, whenever their first report comes."""
    target = new_folder(spark, "late")
    events = inputs.table(spark, folder, "events")
    landed = events.withColumn("landing", F.expr(LANDING.replace("timestamp '", "timestamp_ntz'")))
    for landing in range(3):
        landed.where(F.col("landing") == landing).drop("landing").coalesce(1).write.mode("append").parquet(f"{target}/in")
    stream = spark.readStream.schema(inputs.SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(f"{target}/in")
    start_hourly(
        _reports(stream), f"{target}/table", f"{target}/checkpoint", lambda session: _fleet(session, folder), once=True
    ).awaitTermination()
    stored = read_hourly(spark, f"{target}/table").select("mmsi", "recorded_at", "lat")
    return stored.select("mmsi", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), r6("lat"))
