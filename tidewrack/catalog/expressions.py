"""Scalar expressions and predicates, evaluated over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.registry import query
from tidewrack.constants import HALF_LIFE_DAYS, REGION
from tidewrack.functions import effort as weights
from tidewrack.functions import geodesy, labels, scoring, timeline
from tidewrack.sources.tables import scan_span


def r6(name, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


@query(
    "s7_scan_span",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
       WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1996-04-01'""",
)
def scan_quarter(spark, folder):
    items = inputs.table(spark, folder, "lineitem")
    return scan_span(items, "l_shipdate", "1996-01-01", "1996-04-01").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"
    )


@query(
    "p1_in_bbox",
    """SELECT external_id,
         CASE WHEN lat BETWEEN 42 AND 51.5 AND lon BETWEEN -6 AND 9.5 THEN 1 ELSE 0 END AS inside,
         CASE WHEN lat BETWEEN 41.9 AND 51.6 AND lon BETWEEN -6.1 AND 9.6 THEN 1 ELSE 0 END AS near
       FROM fx_stranding""",
)
def boxed(spark, folder):
    lat, lon = F.col("lat"), F.col("lon")
    return inputs.strandings(spark, folder).select(
        "external_id",
        geodesy.in_box(lat, lon, REGION).cast("int").alias("inside"),
        geodesy.in_box(lat, lon, REGION, 0.1).cast("int").alias("near"),
    )


@query(
    "p2_grid_cell",
    """SELECT external_id, round(lat + 0.00001e0, 4) AS cell_lat, round(lon + 0.00001e0, 4) AS cell_lon
       FROM fx_stranding""",
)
def cells(spark, folder):
    nudge = F.lit(0.00001)
    return inputs.strandings(spark, folder).select(
        "external_id",
        geodesy.grid_cell(F.col("lat") + nudge).alias("cell_lat"),
        geodesy.grid_cell(F.col("lon") + nudge).alias("cell_lon"),
    )


@query(
    "p8_risk_source",
    """SELECT o_orderkey, CASE WHEN cast(o_orderdate AS date) > date '1998-07-01' - 2
         THEN 'forecast' ELSE 'observed' END AS source FROM orders""",
)
def sources(spark, folder):
    return inputs.table(spark, folder, "orders").select(
        "o_orderkey",
        timeline.risk_source(F.to_date("o_orderdate"), F.lit("1998-07-01").cast("date")).alias(
            "source"
        ),
    )


@query(
    "p9_hour_offset",
    """SELECT event_id, cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-10')) / 3600e6) AS bigint)
         AS hours FROM events""",
)
def offsets(spark, folder):
    start = F.lit("2024-01-10").cast("timestamp")
    hours = timeline.hours_between(start, F.col("ts"))
    return (
        inputs.table(spark, folder, "events")
        .select("event_id", hours.alias("hours"))
    )


@query(
    "e1_e3_distances",
    """SELECT external_id,
         round(6371.0088e0 * 2 * asin(sqrt(power(sin(radians(46e0 - lat) / 2), 2)
           + cos(radians(lat)) * cos(radians(46e0)) * power(sin(radians(-2e0 - lon) / 2), 2))), 6) AS great_circle_km,
         round(((degrees(atan2(cos(radians((lat + 46e0) / 2)) * (-2e0 - lon), 46e0 - lat)) + 360e0) % 360e0), 6) AS bearing,
         round(sqrt(power((lat - 46e0) * 110.6e0, 2)
           + power((lon + 2e0) * 111.3e0 * cos(radians(46e0)), 2)), 6) AS flat_km
       FROM fx_stranding""",
)
def distances(spark, folder):
    here = (F.col("lat"), F.col("lon"))
    there = (F.lit(46.0), F.lit(-2.0))
    return inputs.strandings(spark, folder).select(
        "external_id",
        r6("great_circle_km", geodesy.haversine_km(*here, *there)),
        r6("bearing", geodesy.bearing_deg(*here, *there)),
        r6("flat_km", geodesy.planar_km(*here, *there)),
    )


@query(
    "e4_e14_vectors",
    """SELECT valid_at, lat, lon,
         round(coalesce(wind_speed_kmh, 0) / 3.6e0 * sin(radians(coalesce(wind_direction_deg, 0) + 180e0)), 6) AS wind_u,
         round(coalesce(wind_speed_kmh, 0) / 3.6e0 * cos(radians(coalesce(wind_direction_deg, 0) + 180e0)), 6) AS wind_v,
         round(coalesce(current_speed_kmh, 0) / 3.6e0 * sin(radians(coalesce(current_direction_deg, 0))), 6) AS current_u,
         round(coalesce(current_speed_kmh, 0) / 3.6e0 * cos(radians(coalesce(current_direction_deg, 0))), 6) AS current_v,
         round(abs(coalesce(current_speed_kmh, 0) / 3.6e0 * sin(radians(coalesce(current_direction_deg, 0))) * sin(radians(127e0))
           + coalesce(current_speed_kmh, 0) / 3.6e0 * cos(radians(coalesce(current_direction_deg, 0))) * cos(radians(127e0))), 6) AS onshore
       FROM fx_condition""",
)
def vectors(spark, folder):
    wind = geodesy.polar_to_uv(F.col("wind_speed_kmh"), F.col("wind_direction_deg"), True)
    current = geodesy.polar_to_uv(F.col("current_speed_kmh"), F.col("current_direction_deg"), False)
    return inputs.condition(spark, folder).select(
        "valid_at", "lat", "lon",
        r6("wind_u", wind[0]), r6("wind_v", wind[1]),
        r6("current_u", current[0]), r6("current_v", current[1]),
        r6("onshore", geodesy.onshore_component(*current, F.lit(37.0))),
    )


@query(
    "e5_e6_e13_e15_e16_transforms",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         round(ln(1 + greatest(l_quantity - 10, 0) / 12e0), 6) AS scaled,
         round(ln(greatest(least(l_discount, 1 - 1e-9), 1e-9) / (1 - greatest(least(l_discount, 1 - 1e-9), 1e-9))), 6) AS logit,
         round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS sigmoid,
         round(power(0.5e0, l_quantity / 365e0), 6) AS decayed,
         round(1 - exp(-(l_linenumber + 0.5e0) / (greatest(l_linenumber - 3, 1) * 31e0)), 6) AS chance,
         round(100 * greatest(least((ln(greatest(l_discount, 1e-9)) - ln(0.02e0)) / (ln(0.08e0) - ln(0.02e0)), 1), 0), 6) AS risk_index,
         0e0 AS flat_index
       FROM lineitem""",
)
def transforms(spark, folder):
    quantity, discount, line = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    return inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r6("scaled", scoring.log1p_scaled(quantity - 10, 12.0)),
        r6("logit", scoring.logit(discount)),
        r6("sigmoid", scoring.sigmoid((quantity - 25) / 10)),
        r6("decayed", scoring.half_life_decay(quantity, HALF_LIFE_DAYS)),
        r6("chance", scoring.poisson_chance(line, line - 3)),
        r6("risk_index", scoring.risk_index(discount, F.lit(0.02), F.lit(0.08))),
        scoring.risk_index(discount, F.lit(0.05), F.lit(0.05)).alias("flat_index"),
    )


# Text of an event date in one of several shapes, by order key.
EVENT_TEXT = """CASE o_orderkey % 6
    WHEN 0 THEN {day} WHEN 1 THEN concat({day}, '/', {later})
    WHEN 2 THEN concat({day}, 'T10:30:00+02:00') WHEN 3 THEN concat({later}, '/', {day})
    WHEN 4 THEN substring({day}, 1, 7) ELSE concat(' ', {day}, 'T06:00 / ', {later}, 'T18:00:00Z ') END"""
SPARK_EVENT_TEXT = EVENT_TEXT.format(
    day="cast(cast(o_orderdate AS date) AS string)",
    later="cast(date_add(cast(o_orderdate AS date), 2) AS string)",
)


@query(
    "e7_event_window",
    """SELECT o_orderkey,
         CASE o_orderkey % 6 WHEN 0 THEN o_orderdate + to_hours(12) WHEN 1 THEN o_orderdate + to_hours(36)
           WHEN 2 THEN o_orderdate + to_minutes(510) WHEN 5 THEN o_orderdate + to_hours(36) END AS recorded_at,
         CASE o_orderkey % 6 WHEN 0 THEN 12e0 WHEN 1 THEN 36e0 WHEN 2 THEN 0e0 ELSE 30e0 END AS half_width_hours
       FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 5)""",
)
def event_windows(spark, folder):
    window = timeline.event_window(F.expr(SPARK_EVENT_TEXT))
    return (
        inputs.table(spark, folder, "orders")
        .select("o_orderkey", window.alias("w"))
        .filter(F.col("w").isNotNull())
        .select(
            "o_orderkey",
            F.col("w.recorded_at").cast("timestamp_ntz").alias("recorded_at"),
            "w.half_width_hours",
        )
    )


@query(
    "e8_e17_e18_calendar",
    """SELECT o_orderkey,
         cast(dayofyear(make_date(2000, month(o_orderdate), day(o_orderdate))) - 1 AS int) AS slot,
         date '2020-01-06' + cast(floor((cast(o_orderdate AS date) - date '2020-01-06') / 14e0) * 14 AS int) AS bucket,
         date_trunc('hour', o_orderdate + to_minutes(cast(o_orderkey % 1440 AS int))) AS hour_at,
         cast(o_orderdate + to_minutes(cast(o_orderkey % 1440 AS int)) AS date) AS day
       FROM orders""",
)
def calendar_parts(spark, folder):
    day = F.to_date("o_orderdate")
    minute = F.expr("timestampadd(MINUTE, cast(o_orderkey % 1440 AS int), o_orderdate)")
    return inputs.table(spark, folder, "orders").select(
        "o_orderkey",
        timeline.event_slot(day).alias("slot"),
        timeline.chunk_bucket(day, 14).alias("bucket"),
        timeline.floor_hour(minute).cast("timestamp_ntz").alias("hour_at"),
        timeline.utc_day(minute).alias("day"),
    )


@query(
    "e9_identity_hash",
    """SELECT external_id, substring(sha256(concat(
         printf('%.5f', lat), '|', printf('%.5f', lon), '|', source)), 1, 32) AS identity
       FROM fx_stranding""",
)
def identities(spark, folder):
    payload = F.concat_ws(
        "|", labels.coordinate_text(F.col("lat")), labels.coordinate_text(F.col("lon")), "source"
    )
    return inputs.strandings(spark, folder).select(
        "external_id", labels.identity_hash(payload).alias("identity")
    )


@query(
    "e10_normalize_label",
    """SELECT p_partkey, trim(regexp_replace(replace(concat('  ', p_name, chr(160), chr(160), '  x', chr(160)),
         chr(160), ' '), ' +', ' ', 'g')) AS label FROM part""",
)
def cleaned(spark, folder):
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit("\u00a0\u00a0  x\u00a0"))
    return inputs.table(spark, folder, "part").select(
        "p_partkey", labels.normalize_label(raw).alias("label")
    )


@query(
    "e11_e12_effort_weights",
    """SELECT ordinal,
         CASE lower(trim(gear_type)) WHEN 'trawlers' THEN 1e0 WHEN 'set_gillnets' THEN 1e0
           WHEN 'seiners' THEN 0.2e0 ELSE 0.3e0 END AS gear,
         (CASE month(recorded_at + to_days(cast(ordinal % 365 AS int)))
           WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0.9e0 WHEN 4 THEN 0.5e0 WHEN 5 THEN 0.3e0
           WHEN 9 THEN 0.25e0 WHEN 10 THEN 0.4e0 WHEN 11 THEN 0.7e0 WHEN 12 THEN 0.95e0 ELSE 0.2e0 END) AS season
       FROM fx_vessel""",
)
def effort_weights(spark, folder):
    day = F.expr("date_add(cast(recorded_at AS date), cast(ordinal % 365 AS int))")
    return inputs.vessels(spark, folder).select(
        "ordinal",
        weights.gear_weight(F.col("gear_type")).alias("gear"),
        weights.season_weight(day).alias("season"),
    )
