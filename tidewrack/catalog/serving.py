"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.registry import query
from tidewrack.operators import serving


@query(
    "p5_vessels_at_hour",
    """SELECT mmsi, round(lat, 6) AS lat, round(lon, 6) AS lon, ship_name, flag, gear_type, effort_hours, recorded_at, source
       FROM fx_vessel WHERE recorded_at >= timestamp '2024-01-12 09:00:00' AND recorded_at < timestamp '2024-01-12 10:00:00'""",
)
def vessels_at(spark, folder):
    rows = serving.at_hour(
        inputs.vessels(spark, folder), "recorded_at", "2024-01-12 09:41:07", serving.VESSEL_FIELDS
    )
    return rows.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(
    "p5_conditions_at_hour",
    """SELECT lat, lon, cast(forecast AS int) AS forecast, wind_speed_kmh, wave_height_m, sea_level_m
       FROM fx_condition WHERE valid_at = timestamp '2001-06-10 15:00:00'""",
)
def conditions_at(spark, folder):
    fields = ("lat", "lon", "forecast", "wind_speed_kmh", "wave_height_m", "sea_level_m")
    rows = serving.at_hour(
        inputs.condition(spark, folder), "valid_at", "2001-06-10 15:20:00", fields
    )
    return rows.withColumn("forecast", F.col("forecast").cast("int"))


@query(
    "p6_strandings_on",
    """SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, individual_count, recorded_at, source, external_id
       FROM fx_stranding WHERE cast(recorded_at AS date) = date '1998-05-05'""",
)
def on_day(spark, folder):
    rows = serving.strandings_on(inputs.strandings(spark, folder), "1998-05-05")
    return rows.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


def _layer_sql(name, speed, direction):
    return f"""SELECT '{name}' AS layer, lat, lon, {speed} AS speed, {direction} AS direction
        FROM fx_condition WHERE {speed} IS NOT NULL AND {direction} IS NOT NULL"""


@query(
    "p7_condition_layers",
    " UNION ALL ".join(_layer_sql(n, s, d) for n, (s, d, _) in serving.LAYERS.items()),
)
def layers(spark, folder):
    condition = inputs.condition(spark, folder)
    drawn = None
    for name, (speed, direction, _) in serving.LAYERS.items():
        part = serving.condition_layer(condition, name).select(
            F.lit(name).alias("layer"), "lat", "lon",
            F.col(speed).alias("speed"), F.col(direction).alias("direction"),
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn


MONTHS = ",\n".join(
    f"""CASE WHEN year = (SELECT max(year) FROM monthly) AND {m} > (SELECT max(month) FROM monthly
          WHERE year = (SELECT max(year) FROM monthly)) THEN NULL
        ELSE coalesce(cast(max(n) FILTER (WHERE month = {m}) AS double), 0) END AS m{m:02d}"""
    for m in range(1, 13)
)


@query(
    "a7_monthly_matrix",
    f"""WITH monthly AS (SELECT year(recorded_at) AS year, month(recorded_at) AS month,
            sum(individual_count) AS n FROM fx_stranding GROUP BY 1, 2)
        SELECT cast(year AS int) AS year, {MONTHS} FROM monthly GROUP BY year""",
)
def matrix(spark, folder):
    return serving.monthly_matrix(inputs.strandings(spark, folder))


@query(
    "a8_time_range",
    """SELECT min(lo) AS first_at, max(hi) AS last_at FROM (
         SELECT min(valid_at) AS lo, max(valid_at) AS hi FROM fx_condition
         UNION ALL SELECT min(recorded_at), max(recorded_at) FROM fx_vessel)""",
)
def bounds(spark, folder):
    return serving.time_range(inputs.condition(spark, folder), inputs.vessels(spark, folder))


@query(
    "a10_exact_quantiles",
    """SELECT q, round(v, 9) AS value FROM (
         SELECT 0.5e0 AS q, quantile_cont(l_discount * l_quantity / 60e0, 0.5e0) AS v FROM lineitem UNION ALL
         SELECT 0.999e0, quantile_cont(l_discount * l_quantity / 60e0, 0.999e0) FROM lineitem UNION ALL
         SELECT 0.123e0, quantile_cont(l_discount * l_quantity / 60e0, 0.123e0) FROM lineitem)""",
)
def quantiles(spark, folder):
    from tidewrack.operators.ranking import exact_quantiles

    values = inputs.table(spark, folder, "lineitem").select(
        F.expr("l_discount * l_quantity / 60e0").alias("value")
    )
    return exact_quantiles(values, "value", (0.5, 0.999, 0.123)).select(
        "q", F.round("value", 9).alias("value")
    )
