"""Hourly gridded weather payloads.

A landed record is one JSON text per request: {"points": [[lat, lon], ...], "answer": ...}
where the answer is a list of locations, or a single location, in request order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import GRID_STEP_DEG, SEA_VARIABLES, WIND_VARIABLES
from tidewrack.functions.timeline import utc_instant


class Product(NamedTuple):
    name: str
    variables: dict[str, str]
    native_step_deg: float


PRODUCTS = {
    "weather_archive": Product("weather_archive", WIND_VARIABLES, 0.25),
    "weather_forecast": Product("weather_forecast", WIND_VARIABLES, 0.25),
    "marine_archive": Product("marine_archive", SEA_VARIABLES, 1 / 12),
    "marine_forecast": Product("marine_forecast", SEA_VARIABLES, 1 / 12),
}


def parse_hourly_weather(payloads: DataFrame, product: Product, text: str = "value") -> DataFrame:
    """One row per requested cell and hour with at least one known variable.

    Answers from a cell further than half a grid step away are dropped. An answer whose
    length differs from its request, or series of unequal length, are errors.
    """
    series = ", ".join(f"`{v}`: array<double>" for v in product.variables)
    location = (
        "struct<latitude: double, longitude: double,"
        f" hourly: struct<`time`: array<string>, {series}>>"
    )
    outer = F.from_json(F.col(text), "points array<array<double>>, answer string")
    request = payloads.select(outer.alias("r")).select(
        "r.points", F.from_json("r.answer", f"array<{location}>").alias("answer")
    )
    paired = request.select(
        # Outer, here and below: an inner explode would parse once more to skip empty ones.
        F.explode_outer(
            _checked(
                F.size("points") == F.size("answer"),
                F.arrays_zip("points", "answer"),
                "payload answers do not match the requested points",
            )
        ).alias("z")
    ).select(
        F.get("z.points", F.lit(0)).alias("lat"),
        F.get("z.points", F.lit(1)).alias("lon"),
        F.col("z.answer").alias("a"),
    )
    tolerance = max(GRID_STEP_DEG, product.native_step_deg) / 2 + 1e-9
    near = F.greatest(
        F.abs(F.col("a.latitude") - F.col("lat")), F.abs(F.col("a.longitude") - F.col("lon"))
    )
    names = ["time", *product.variables]
    hourly = [F.col(f"a.hourly.`{n}`") for n in names]
    equal = None
    for column in hourly[1:]:
        same = F.coalesce(F.size(column) == F.size(hourly[0]), F.lit(False))
        equal = same if equal is None else equal & same
    zipped = _checked(
        equal,
        F.arrays_zip(*(c.alias(n) for c, n in zip(hourly, names, strict=True))),
        "payload series have unequal lengths",
    )
    rows = paired.filter(near <= tolerance).select("lat", "lon", F.inline_outer(zipped))
    columns = list(product.variables.values())
    return (
        rows.withColumnsRenamed(product.variables)
        .dropna(how="all", subset=columns)
        .select(utc_instant(F.col("time")).alias("valid_at"), "lat", "lon", *columns)
    )


def _checked(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def read_hourly_weather(spark: SparkSession, path: str, product: Product) -> DataFrame:
    return parse_hourly_weather(spark.read.text(path), product)
