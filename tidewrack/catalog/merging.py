"""Merges: upserts, guarded writes, replacements, precedence, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.registry import query
from tidewrack.constants import SEA_MEASURES, WIND_MEASURES
from tidewrack.operators import merging
from tidewrack.operators.shoreline import guarded_prune, prune_report, stale_rows

KEYS = list(inputs.DRIFT_KEYS)


def _version(spark, folder, versions):
    rows = inputs.drift_versions(spark, folder).filter(F.col("model_version").isin(versions))
    return merging.last_per_key(rows, KEYS, ["model_version", "id", "drift_index"])


VERSION_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY release_day, day,
  coastal_segment_id ORDER BY model_version DESC, id DESC, drift_index DESC) AS n
  FROM fx_drift_version WHERE model_version IN ({0})) WHERE n = 1"""
A_N, N_R, R = (VERSION_SQL.format(v) for v in ("'A', 'N'", "'N', 'R'", "'R'"))


@query(
    "w8_dedupe_last",
    f"SELECT release_day, day, coastal_segment_id, model_version, id, drift_index FROM ({A_N})",
)
def dedupe(spark, folder):
    return _version(spark, folder, ["A", "N"])


@query(
    "s9_merge_upsert",
    f"""WITH t AS ({A_N}), u AS ({N_R})
        SELECT coalesce(t.release_day, u.release_day) AS release_day, coalesce(t.day, u.day) AS day,
          coalesce(t.coastal_segment_id, u.coastal_segment_id) AS coastal_segment_id,
          coalesce(u.model_version, t.model_version) AS model_version,
          coalesce(u.id, t.id) AS id, coalesce(u.drift_index, t.drift_index) AS drift_index
        FROM t FULL JOIN u ON t.release_day = u.release_day AND t.day = u.day
          AND t.coastal_segment_id = u.coastal_segment_id""",
)
def upsert(spark, folder):
    stored, updates = _version(spark, folder, ["A", "N"]), _version(spark, folder, ["N", "R"])
    return merging.merge_upsert(stored, updates, KEYS, overwrite=True)


@query(
    "s9_merge_upsert_guarded",
    f"""WITH t AS ({A_N}), u AS ({N_R})
        SELECT coalesce(t.release_day, u.release_day) AS release_day, coalesce(t.day, u.day) AS day,
          coalesce(t.coastal_segment_id, u.coastal_segment_id) AS coastal_segment_id,
          coalesce(t.model_version, u.model_version) AS model_version, coalesce(t.id, u.id) AS id,
          CASE WHEN t.id IS NULL OR (u.id IS NOT NULL AND t.drift_index < 1) THEN u.drift_index
               ELSE t.drift_index END AS drift_index
        FROM t FULL JOIN u ON t.release_day = u.release_day AND t.day = u.day
          AND t.coastal_segment_id = u.coastal_segment_id""",
)
def guarded_upsert(spark, folder):
    stored, updates = _version(spark, folder, ["A", "N"]), _version(spark, folder, ["N", "R"])
    return merging.merge_upsert(
        stored, updates, KEYS, overwrite=True, only=["drift_index"], where="drift_index < 1"
    )


@query(
    "s10_replace_scope",
    """SELECT release_day, day, coastal_segment_id, drift_index FROM fx_drift_daily
       WHERE release_day NOT BETWEEN date '1997-01-01' AND date '1998-12-31'
       UNION ALL
       SELECT release_day, day, coastal_segment_id, drift_index * 2 FROM fx_drift_daily
       WHERE release_day BETWEEN date '1997-01-01' AND date '1998-12-31' AND drift_index > 0""",
)
def replaced(spark, folder):
    stored = inputs.drift_daily(spark, folder)
    scope = F.col("release_day").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    fresh = stored.filter(scope & (F.col("drift_index") > 0)).withColumn(
        "drift_index", F.col("drift_index") * 2
    )
    return merging.replace_scope(stored, fresh, scope)


ONE_SOURCE = """(SELECT valid_at, lat, lon, {cols} FROM fx_marine_condition
  WHERE source = '{source}' GROUP BY 1, 2, 3)"""


def _max_of(names):
    return ", ".join(f"max({n}) AS {n}" for n in names)


def _rows_of(spark, folder, source, names):
    return (
        inputs.marine_condition(spark, folder)
        .filter(F.col("source") == source)
        .groupBy("valid_at", "lat", "lon")
        .agg(*(F.max(n).alias(n) for n in names))
    )


LIVE = ONE_SOURCE.format(cols=_max_of(SEA_MEASURES), source="marine_forecast")
ARCHIVED = ONE_SOURCE.format(cols=_max_of(WIND_MEASURES), source="weather_archive")


@query(
    "s11_forecast_guarded_write",
    f"""SELECT coalesce(c.valid_at, u.valid_at) AS valid_at, coalesce(c.lat, u.lat) AS lat,
          coalesce(c.lon, u.lon) AS lon,
          cast(CASE WHEN c.valid_at IS NULL THEN true ELSE c.forecast END AS int) AS forecast,
          c.wind_speed_kmh,
          CASE WHEN c.valid_at IS NULL OR (c.forecast AND u.valid_at IS NOT NULL)
               THEN u.wave_height_m * 2 ELSE c.wave_height_m END AS wave_height_m
        FROM fx_condition c FULL JOIN (SELECT valid_at + to_hours(1) AS valid_at, lat, lon,
          wave_height_m FROM {LIVE}) u
          ON c.valid_at = u.valid_at AND c.lat = u.lat AND c.lon = u.lon""",
)
def live_write(spark, folder):
    """A live marine run one hour later: new hours appear, archived hours stay as they are."""
    rows = (
        _rows_of(spark, folder, "marine_forecast", SEA_MEASURES)
        .withColumn("valid_at", F.expr("timestampadd(HOUR, 1, valid_at)"))
        .withColumn("wave_height_m", F.col("wave_height_m") * 2)
    )
    return merging.forecast_guarded_write(
        inputs.condition(spark, folder), rows, SEA_MEASURES, live=True
    ).select(
        "valid_at", "lat", "lon", F.col("forecast").cast("int").alias("forecast"),
        "wind_speed_kmh", "wave_height_m",
    )


@query(
    "s11_archive_write",
    f"""SELECT coalesce(c.valid_at, u.valid_at) AS valid_at, coalesce(c.lat, u.lat) AS lat,
          coalesce(c.lon, u.lon) AS lon,
          cast(CASE WHEN u.valid_at IS NULL THEN c.forecast ELSE false END AS int) AS forecast,
          CASE WHEN u.valid_at IS NULL THEN c.wind_speed_kmh ELSE u.wind_speed_kmh END AS wind_speed_kmh,
          c.wave_height_m
        FROM fx_condition c FULL JOIN (SELECT valid_at + to_hours(1) AS valid_at, lat, lon,
          wind_speed_kmh FROM {ARCHIVED}) u
          ON c.valid_at = u.valid_at AND c.lat = u.lat AND c.lon = u.lon""",
)
def archive_write(spark, folder):
    rows = _rows_of(spark, folder, "weather_archive", WIND_MEASURES).withColumn(
        "valid_at", F.expr("timestampadd(HOUR, 1, valid_at)")
    )
    return merging.forecast_guarded_write(
        inputs.condition(spark, folder), rows, WIND_MEASURES, live=False
    ).select(
        "valid_at", "lat", "lon", F.col("forecast").cast("int").alias("forecast"),
        "wind_speed_kmh", "wave_height_m",
    )


@query(
    "j12_insert_if_absent",
    f"""SELECT release_day, day, coastal_segment_id, model_version, id, drift_index FROM ({A_N}) t
        UNION ALL
        SELECT release_day, day, coastal_segment_id, model_version, id, drift_index FROM ({R}) u
        WHERE NOT EXISTS (SELECT 1 FROM fx_drift_version v WHERE v.model_version IN ('A', 'N')
          AND v.release_day = u.release_day AND v.day = u.day
          AND v.coastal_segment_id = u.coastal_segment_id)""",
)
def first_write(spark, folder):
    stored, rows = _version(spark, folder, ["A", "N"]), _version(spark, folder, ["R"])
    return merging.merge_upsert(stored, rows, KEYS, overwrite=False)


@query(
    "a14_merge_by_precedence",
    """SELECT valid_at, lat, lon, cast(forecast AS int) AS forecast, wind_speed_kmh, wind_direction_deg,
         wave_height_m, wave_direction_deg, wave_period_s, swell_height_m FROM fx_condition""",
)
def precedence(spark, folder):
    return inputs.condition(spark, folder).select(
        "valid_at", "lat", "lon", F.col("forecast").cast("int").alias("forecast"),
        "wind_speed_kmh", "wind_direction_deg", "wave_height_m", "wave_direction_deg",
        "wave_period_s", "swell_height_m",
    )


@query(
    "w10_keep_newest",
    "SELECT release_day, day, coastal_segment_id, drift_index FROM fx_drift_daily",
)
def newest(spark, folder):
    return inputs.drift_daily(spark, folder)


@query(
    "a19_reconcile",
    """SELECT 'condition' AS table_name, a AS keys_before, b AS rows_after,
              CASE WHEN a = b THEN 'yes' ELSE 'no' END AS kept
       FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT valid_at, lat, lon FROM fx_marine_condition)) AS a,
                    (SELECT count(*) FROM fx_condition) AS b)
       UNION ALL
       SELECT 'drift_daily', a, b, CASE WHEN a = b THEN 'yes' ELSE 'no' END
       FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT release_day, day, coastal_segment_id
                                           FROM fx_drift_version)) AS a,
                    (SELECT count(*) FROM fx_drift_daily) AS b)""",
)
def reconciled(spark, folder):
    return merging.reconcile(
        {
            "condition": (inputs.marine_condition(spark, folder), inputs.condition(spark, folder)),
            "drift_daily": (inputs.drift_versions(spark, folder), inputs.drift_daily(spark, folder)),
        },
        {"condition": ["valid_at", "lat", "lon"], "drift_daily": KEYS},
    )


@query(
    "j11_orphans",
    """SELECT d.release_day, d.day, d.coastal_segment_id, d.drift_index FROM fx_drift_daily d
       WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = d.coastal_segment_id AND s_acctbal >= 0)""",
)
def orphaned(spark, folder):
    kept = inputs.table(spark, folder, "supplier").filter(F.col("s_acctbal") >= 0)
    return merging.orphans(
        inputs.drift_daily(spark, folder), kept, "coastal_segment_id", "s_suppkey"
    )


def _identified(spark, folder):
    return inputs.table(spark, folder, "customer").select(
        F.col("c_name").alias("external_id"), "c_acctbal", F.col("c_custkey").alias("segment_id")
    )


@query(
    "j10_stale_rows",
    """SELECT c_name AS external_id, c_custkey AS segment_id FROM customer WHERE c_acctbal < -900""",
)
def stale(spark, folder):
    stored = _identified(spark, folder)
    keep = stored.filter(F.col("c_acctbal") >= -900)
    return stale_rows(stored.drop("c_acctbal"), keep)


@query(
    "j10_prune_guard",
    """SELECT count(*) AS stored, count(*) FILTER (WHERE c_acctbal < 0) AS stale,
         greatest(5, cast(floor(0.05e0 * count(*)) AS bigint)) AS allowed,
         CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > greatest(5, cast(floor(0.05e0 * count(*)) AS bigint))
              THEN 'yes' ELSE 'no' END AS refused
       FROM customer""",
)
def prune_guard(spark, folder):
    stored = _identified(spark, folder)
    return prune_report(stored, stored.filter(F.col("c_acctbal") >= 0))


@query(
    "j10_guarded_prune",
    "SELECT c_name AS external_id, c_custkey AS segment_id FROM customer WHERE c_acctbal >= -900",
)
def pruned(spark, folder):
    stored = _identified(spark, folder)
    keep = stored.filter(F.col("c_acctbal") >= -900)
    return guarded_prune(stored.drop("c_acctbal"), keep)


@query(
    "u1_union_strandings",
    """SELECT source, external_id, recorded_at, round(lat, 6) AS lat, round(lon, 6) AS lon, individual_count
       FROM fx_stranding""",
)
def stranding_sources(spark, folder):
    """Two stranding sources merged into one table on (source, external_id)."""
    rows = inputs.strandings(spark, folder)
    columns = ["source", "external_id", "recorded_at", "lat", "lon", "individual_count"]
    first = rows.filter(F.col("source") == "gbif").select(columns)
    second = rows.filter(F.col("source") != "gbif").select(columns)
    both = merging.merge_upsert(first, second, ["source", "external_id"], overwrite=True)
    return both.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(
    "u2_union_vessels",
    """WITH effort AS (SELECT mmsi, recorded_at, sum(coalesce(effort_hours, 0)) AS effort_hours
           FROM fx_vessel WHERE source = 'gfw_fishing' GROUP BY 1, 2),
         live AS (SELECT DISTINCT mmsi, recorded_at FROM fx_vessel WHERE source = 'ais_live')
       SELECT mmsi, recorded_at, 'gfw_fishing' AS source, round(effort_hours, 6) AS effort_hours FROM effort
       UNION ALL
       SELECT mmsi, recorded_at, 'ais_live', NULL FROM live
       WHERE NOT EXISTS (SELECT 1 FROM effort e WHERE e.mmsi = live.mmsi AND e.recorded_at = live.recorded_at)""",
)
def vessel_sources(spark, folder):
    """Live hours never overwrite; effort hours do."""
    from tidewrack.operators.effort import collapse_cells

    rows = inputs.vessels(spark, folder)
    keys = ["mmsi", "recorded_at"]
    live = merging.last_per_key(
        rows.filter(F.col("source") == "ais_live"), keys, ["ordinal"]
    ).drop("ordinal")
    effort = collapse_cells(rows.filter(F.col("source") == "gfw_fishing"))
    return merging.merge_upsert(live, effort.select(*live.columns), keys, overwrite=True).select(
        *keys, "source", F.round("effort_hours", 6).alias("effort_hours")
    )


@query("u4_distinct_years", "SELECT DISTINCT year(o_orderdate) AS year FROM orders")
def distinct_years(spark, folder):
    return inputs.table(spark, folder, "orders").select(
        F.year("o_orderdate").cast("long").alias("year")
    ).distinct()


@query("u4_distinct_roster", "SELECT DISTINCT mmsi FROM fx_vessel WHERE source = 'gfw_fishing'")
def distinct_roster(spark, folder):
    rows = inputs.vessels(spark, folder)
    return rows.filter(F.col("source") == "gfw_fishing").select("mmsi").distinct()
