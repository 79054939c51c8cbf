"""Registration of queries, and the SQL views their counterparts may use."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewrack.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MEASURES_SQL = (
    "wind_speed_kmh", "wind_direction_deg", "current_speed_kmh", "current_direction_deg",
    "wave_height_m", "wave_direction_deg", "wave_period_s", "swell_height_m",
    "swell_direction_deg", "swell_period_s", "sea_surface_temperature_c", "sea_level_m",
)


def _precedence() -> str:
    parts = []
    for name in MEASURES_SQL:
        product = "weather" if name.startswith("wind") else "marine"
        parts.append(
            f"coalesce(max({name}) FILTER (WHERE source = '{product}_archive'),"
            f" max({name}) FILTER (WHERE source = '{product}_forecast')) AS {name}"
        )
    return ",\n".join(parts)


FIRST_DAY, LAST_DAY, AS_OF = "2001-06-03", "2001-07-02", "2001-07-01"

# Views in plain SQL: brute force throughout (no tiles, no running sums).
VIEWS: dict[str, str] = {
    "fx_segment": """
        SELECT s_suppkey AS segment_id,
               42e0 + (s_suppkey * 7919 % 9500) / 1000e0 AS center_lat,
               -6e0 + (s_suppkey * 104729 % 15500) / 1000e0 AS center_lon,
               8e0 + s_suppkey % 5 AS length_km,
               cast(s_suppkey * 37 % 360 AS double) AS orientation_deg
        FROM supplier""",
    "fx_segment_point": """
        SELECT segment_id, k AS seq, center_lat + (k - 2) * 0.02e0 AS lat,
               center_lon + (k - 2) * 0.01e0 AS lon
        FROM fx_segment, (SELECT unnest(range(5)) AS k)""",
    "fx_line_point": """
        SELECT c_custkey AS line_id, k AS seq,
               42e0 + c_nationkey * 0.35e0 + ((c_custkey + k * k) % 7) * 0.005e0 AS lat,
               -5.997e0 + (c_custkey * 13 % 310) * 0.05e0 + k * 0.03e0 AS lon
        FROM customer, (SELECT unnest(range(40)) AS k)""",
    "fx_stranding": """
        SELECT cast(o_orderkey AS varchar) AS external_id,
               CASE WHEN o_orderstatus = 'F' THEN 'gbif' ELSE 'pelagis_histocarto' END AS source,
               o_orderdate AS recorded_at,
               center_lat + (o_orderkey % 401 - 200) / 1000e0 AS lat,
               center_lon + (o_orderkey % 343 - 171) / 1000e0 AS lon,
               cast(1 + o_orderkey % 3 AS int) AS individual_count
        FROM orders JOIN fx_segment
          ON segment_id = o_custkey % (SELECT count(*) FROM supplier)""",
    "fx_vessel": """
        SELECT cast(user_id AS varchar) AS mmsi, date_trunc('hour', ts) AS recorded_at,
               42e0 + (event_id * 7919 % 9500) / 1000e0 AS lat,
               -6e0 + (event_id * 104729 % 15500) / 1000e0 AS lon,
               CASE event_type WHEN 'click' THEN 'trawlers' WHEN 'view' THEN NULL
                    WHEN 'purchase' THEN 'Set_Gillnets' WHEN 'signup' THEN 'seiners'
                    ELSE 'dredging' END AS gear_type,
               CASE WHEN event_type = 'error' THEN 'ais_live' ELSE 'gfw_fishing' END AS source,
               CASE WHEN event_type = 'error' THEN NULL ELSE value / 100e0 END AS effort_hours,
               CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
                    ELSE 'SHIP ' || cast(event_id AS varchar) END AS ship_name,
               substring('FRESGBPT', cast(1 + 2 * (event_id % 4) AS int), 2) AS flag,
               event_id AS ordinal
        FROM events""",
    "fx_marine_condition": """
        SELECT timestamp '2001-06-01 00:00:00' + to_hours(cast(l_orderkey % 720 AS int)) AS valid_at,
               42e0 + 0.25e0 * (l_partkey % 39) AS lat,
               -6e0 + 0.25e0 * (l_suppkey * 31 % 63) AS lon,
               CASE l_returnflag WHEN 'A' THEN 'marine_archive' WHEN 'N' THEN 'marine_forecast'
                    ELSE 'weather_archive' END AS source,
               CASE WHEN l_returnflag = 'R' THEN l_tax * 500e0 END AS wind_speed_kmh,
               CASE WHEN l_returnflag = 'R'
                    THEN cast(floor(l_extendedprice / 7e0) AS bigint) % 360 * 1e0 END AS wind_direction_deg,
               CASE WHEN l_returnflag <> 'R' THEN l_discount * 40e0 END AS current_speed_kmh,
               CASE WHEN l_returnflag <> 'R' THEN l_partkey * 11 % 360 * 1e0 END AS current_direction_deg,
               CASE WHEN l_returnflag <> 'R' AND l_linenumber <> 7
                    THEN l_quantity / 10e0 END AS wave_height_m,
               CASE WHEN l_returnflag <> 'R'
                    THEN cast(floor(l_extendedprice) AS bigint) % 360 * 1e0 END AS wave_direction_deg,
               CASE WHEN l_returnflag <> 'R' THEN 4e0 + l_linenumber END AS wave_period_s,
               CASE WHEN l_returnflag <> 'R' AND l_linenumber % 5 <> 0
                    THEN l_quantity / 20e0 END AS swell_height_m,
               cast(NULL AS double) AS swell_direction_deg,
               cast(NULL AS double) AS swell_period_s,
               cast(NULL AS double) AS sea_surface_temperature_c,
               CASE WHEN l_returnflag <> 'R' THEN (l_orderkey % 50 - 25) / 10e0 END AS sea_level_m
        FROM lineitem""",
    "fx_condition": f"""
        SELECT valid_at, lat, lon,
               bool_and(source IN ('weather_forecast', 'marine_forecast')) AS forecast,
               {_precedence()}
        FROM fx_marine_condition GROUP BY valid_at, lat, lon""",
    "fx_drift_version": """
        SELECT cast(l_shipdate AS date) AS release_day,
               cast(l_shipdate AS date) + l_linenumber AS day,
               l_suppkey AS coastal_segment_id, l_returnflag AS model_version,
               l_orderkey * 10 + l_linenumber AS id, l_quantity * l_discount AS drift_index
        FROM lineitem""",
    "fx_drift_daily": """
        SELECT release_day, day, coastal_segment_id, drift_index FROM (
          SELECT *, row_number() OVER (PARTITION BY release_day, day, coastal_segment_id
                 ORDER BY model_version DESC, id DESC, drift_index DESC) AS n
          FROM fx_drift_version) WHERE n = 1""",
    "fx_ledger": """
        SELECT *,
               CASE WHEN status = 'failed'
                    THEN 'no input after ' || cast(deferrals AS varchar) || chr(10) || 'see log' END AS error,
               CASE WHEN status = 'pending' AND deferrals > 0
                    THEN cast(day AS timestamp) + to_hours(deferrals) END AS not_before
        FROM (
          SELECT CASE o_orderkey % 4 WHEN 0 THEN 'gfw' WHEN 1 THEN 'weather_archive'
                      WHEN 2 THEN 'drift' ELSE 'risk' END AS kind,
                 cast(o_orderdate + INTERVAL 312 MONTH AS date) AS day,
                 min(CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END) AS status,
                 min(cast(o_orderkey % 3 AS int)) AS attempts,
                 min(cast(o_custkey % 168 AS int)) AS deferrals
          FROM orders GROUP BY 1, 2)""",
    "fx_calendar": """
        SELECT DISTINCT cast(o_orderdate + INTERVAL 312 MONTH AS date) AS as_of FROM orders""",
    "fx_kind": """
        SELECT * FROM (VALUES
          ('gfw', date '2012-01-01', date '9999-12-31', 4, 0, 1, 0, false),
          ('weather_archive', date '1940-01-01', date '9999-12-31', 5, 0, 14, 19, false),
          ('marine_archive', date '2022-01-01', date '9999-12-31', 5, 0, 14, 19, false),
          ('forecast', date '0001-01-01', date '9999-12-31', 0, 0, 1, 1, true),
          ('strandings_gbif', date '0001-01-01', date '2022-12-31', 0, 0, 365, 0, false),
          ('strandings_pelagis', date '2023-01-01', date '9999-12-31', 0, 0, 30, 60, false),
          ('drift', date '2022-01-01', date '9999-12-31', 4, 0, 1, 20, false),
          ('risk', date '2022-01-01', date '9999-12-31', 0, 3, 1, 23, false))
          AS k(kind, first_ok, last_ok, lag_days, ahead_days, chunk_days, volatile_days, rolling)""",
    "fx_plan": """
        SELECT DISTINCT kind, as_of,
               CASE WHEN rolling THEN as_of ELSE date '2020-01-06' + cast(
                 floor((d - date '2020-01-06') / cast(chunk_days AS double)) * chunk_days AS int) END AS bucket
        FROM (SELECT *, as_of + cast(o AS int) AS d FROM fx_calendar, fx_kind,
                     (SELECT unnest(range(-14, 4)) AS o))
        WHERE rolling OR (d >= first_ok AND d <= least(last_ok, as_of + ahead_days - lag_days))""",
    # snapping, by comparing every node with every segment point
    "fx_noded": """
        SELECT *, cast(greatest(least(round_even((lat - 42e0) / 0.02e0, 0), 475e0), 0e0) AS int) AS node_row,
               cast(greatest(least(round_even((lon + 6e0) / 0.02e0, 0), 775e0), 0e0) AS int) AS node_col
        FROM fx_stranding""",
    "fx_node_segment": """
        SELECT node_row, node_col, arg_min(segment_id, (d, segment_id)) AS segment_id, min(d) AS distance_km
        FROM (SELECT node_row, node_col, segment_id,
                     sqrt(power((42e0 + node_row * 0.02e0 - lat) * 110.6e0, 2)
                        + power((-6e0 + node_col * 0.02e0 - lon) * 111.3e0 * cos(radians(lat)), 2)) AS d
              FROM (SELECT DISTINCT node_row, node_col FROM fx_noded), fx_segment_point)
        WHERE d <= 15e0 GROUP BY node_row, node_col""",
    "fx_snapped": """
        SELECT external_id, recorded_at, individual_count, segment_id, distance_km
        FROM fx_noded JOIN fx_node_segment USING (node_row, node_col)""",
    "fx_observed": """
        SELECT segment_id, cast(recorded_at AS date) AS day, count(*) AS records
        FROM fx_snapped GROUP BY 1, 2""",
    "fx_slotted": """
        SELECT segment_id, year(day) AS year,
               dayofyear(make_date(2000, month(day), day(day))) - 1 AS slot, sum(records) AS records
        FROM fx_observed GROUP BY 1, 2, 3""",
    "fx_windowed": """
        SELECT segment_id, year, (slot + o + 366) % 366 AS slot, sum(records) AS records
        FROM fx_slotted, (SELECT unnest(range(-15, 16)) AS o) GROUP BY 1, 2, 3""",
    "fx_sea": """
        SELECT cast(valid_at AS date) AS day, lat, lon,
               coalesce(avg(swell_height_m), 0) AS swell_m, coalesce(avg(wave_height_m), 0) AS wave_m,
               coalesce(avg(wave_period_s), 0) AS period_s,
               coalesce(avg(wave_height_m * sin(radians(wave_direction_deg + 180e0))), 0) AS east_m,
               coalesce(avg(wave_height_m * cos(radians(wave_direction_deg + 180e0))), 0) AS north_m
        FROM fx_condition WHERE wave_height_m IS NOT NULL GROUP BY 1, 2, 3""",
    "fx_weight": """
        SELECT * FROM (
          SELECT segment_id, lat, lon, exp(-0.5e0 * power(d / 25e0, 2)) AS weight, d
          FROM (SELECT segment_id, lat, lon,
                  sqrt(power((center_lat - lat) * 111.2e0, 2)
                     + power((center_lon - lon) * 111.2e0
                       * (SELECT cos(radians(avg(center_lat))) FROM fx_segment), 2)) AS d
                FROM fx_segment, (SELECT DISTINCT lat, lon FROM fx_sea)))
        WHERE d <= 75e0""",
    "fx_kernel": """
        SELECT segment_id, day, sum(weight * swell_m) / sum(weight) AS swell_m,
               sum(weight * wave_m) / sum(weight) AS wave_m,
               sum(weight * period_s) / sum(weight) AS period_s,
               sum(weight * east_m) / sum(weight) AS east_m,
               sum(weight * north_m) / sum(weight) AS north_m
        FROM fx_weight JOIN fx_sea USING (lat, lon) GROUP BY 1, 2""",
    "fx_spine": f"""
        SELECT segment_id, orientation_deg, day
        FROM fx_segment, (SELECT cast(unnest(generate_series(timestamp '{FIRST_DAY}',
             timestamp '{LAST_DAY}', INTERVAL 1 DAY)) AS date) AS day)
        WHERE day - 2 IN (SELECT day FROM fx_sea)""",
    "fx_persistence": """
        SELECT s.segment_id, s.day,
               coalesce(sum(o.records * power(0.5e0, ((s.day - 3) - o.day) / 365e0)), 0) AS persistence
        FROM fx_spine s LEFT JOIN fx_observed o
          ON o.segment_id = s.segment_id AND o.day < s.day - 3 GROUP BY 1, 2""",
    "fx_drift_recent": """
        SELECT s.segment_id, s.day, coalesce(sum(d.drift_index), 0) AS drift_index
        FROM fx_spine s LEFT JOIN fx_drift_daily d
          ON d.coastal_segment_id = s.segment_id AND d.day BETWEEN s.day - 3 AND s.day
        GROUP BY 1, 2""",
    "fx_signal": """
        SELECT s.segment_id, s.day, persistence, drift_index, coalesce(swell_m, 0) AS swell_m,
               coalesce(wave_m, 0) AS wave_m,
               abs(coalesce(east_m, 0) * sin(radians(orientation_deg + 90e0))
                 + coalesce(north_m, 0) * cos(radians(orientation_deg + 90e0))) AS onshore_m,
               coalesce(period_s, 0) AS period_s
        FROM fx_spine s JOIN fx_persistence USING (segment_id, day)
        JOIN fx_drift_recent USING (segment_id, day)
        LEFT JOIN fx_kernel k ON k.segment_id = s.segment_id AND k.day = s.day - 2""",
    "fx_year": "SELECT DISTINCT year FROM fx_slotted",
    "fx_order_day": """
        SELECT cast(unnest(generate_series(cast(min(o_orderdate) AS timestamp), cast(max(o_orderdate) AS timestamp),
                 INTERVAL 1 DAY)) AS date) AS day FROM orders""",
    "fx_long_seasonal": """
        SELECT segment_id, day, n AS records,
               1e0 - exp(-(n + 0.5e0) / (greatest(years, 1) * 31e0)) AS seasonal
        FROM (SELECT s.segment_id, s.day, coalesce(sum(w.records), 0) AS n,
                     (SELECT count(*) FROM fx_year)
                       - CASE WHEN year(s.day) IN (SELECT year FROM fx_year) THEN 1 ELSE 0 END AS years
              FROM (SELECT segment_id, day FROM fx_segment, fx_order_day) s
              LEFT JOIN fx_windowed w ON w.segment_id = s.segment_id
                AND w.slot = dayofyear(make_date(2000, month(s.day), day(s.day))) - 1
                AND w.year <> year(s.day)
              GROUP BY 1, 2)""",
    "fx_seasonal": """
        SELECT segment_id, day, n AS records,
               1e0 - exp(-(n + 0.5e0) / (greatest(years, 1) * 31e0)) AS seasonal
        FROM (SELECT s.segment_id, s.day, coalesce(sum(w.records), 0) AS n,
                     (SELECT count(*) FROM fx_year)
                       - CASE WHEN year(s.day) IN (SELECT year FROM fx_year) THEN 1 ELSE 0 END AS years
              FROM fx_spine s LEFT JOIN fx_windowed w ON w.segment_id = s.segment_id
                AND w.slot = dayofyear(make_date(2000, month(s.day), day(s.day))) - 1
                AND w.year <> year(s.day)
              GROUP BY 1, 2)""",
    "fx_risk": f"""
        SELECT day, segment_id,
               CASE WHEN day > date '{AS_OF}' - 2 THEN 'forecast' ELSE 'observed' END AS source,
               seasonal AS probability, seasonal, persistence, drift_index, swell_m, wave_m,
               onshore_m, period_s
        FROM fx_signal JOIN fx_seasonal USING (segment_id, day)""",
    "fx_anchor": """
        SELECT coalesce(quantile_cont(probability, 0.5e0), 0) AS low,
               coalesce(quantile_cont(probability, 0.999e0), 0) AS high FROM fx_risk""",
    "fx_labelled": """
        SELECT r.*, CASE WHEN o.segment_id IS NULL THEN 0e0 ELSE 1e0 END AS struck
        FROM fx_risk r LEFT JOIN fx_observed o USING (segment_id, day)""",
    "fx_roster": """
        SELECT mmsi,
          (SELECT nullif(arg_max(flag, (recorded_at, flag)), '') FROM fx_vessel v WHERE v.mmsi = m.mmsi
             AND source = 'gfw_fishing' AND flag IS NOT NULL) AS flag,
          (SELECT nullif(arg_max(gear_type, (recorded_at, gear_type)), '') FROM fx_vessel v WHERE v.mmsi = m.mmsi
             AND source = 'gfw_fishing' AND gear_type IS NOT NULL) AS gear_type,
          (SELECT nullif(arg_max(ship_name, (recorded_at, ship_name)), '') FROM fx_vessel v WHERE v.mmsi = m.mmsi
             AND source = 'gfw_fishing' AND ship_name IS NOT NULL) AS ship_name
        FROM (SELECT DISTINCT mmsi FROM fx_vessel WHERE source = 'gfw_fishing') m""",
}


def _needed(text: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(body: str) -> str:
    """The query with the views it uses as common table expressions."""
    names = _needed(body, [])
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in names)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[len('WITH RECURSIVE '):]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def plain_zeros(sql: str) -> str:
    """Adds 0 to every rounded value: Spark's round never gives -0.0, the other engine's may."""
    ends = []
    for start in [m.end() for m in re.finditer(r"\bround\(", sql)]:
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        ends.append(end)
    parts, at = [], 0
    for end in sorted(ends):
        parts.append(sql[at:end] + " + 0e0")
        at = end
    return "".join(parts) + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def utc(spark: SparkSession, folder: str) -> DataFrame:
            return run(use_utc(spark), folder)

        QUERIES[name] = utc
        if sql is not None:
            SQL[name] = plain_zeros(with_views(sql))
        return run

    return register
