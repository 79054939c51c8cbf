"""Coastline GeoJSON and grid-point lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import LINE_MARGIN_DEG, REGION, Box
from tidewrack.functions.geodesy import grid_cell, in_box
from tidewrack.functions.labels import readable
from tidewrack.sources.features import read_features

FEATURES = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
FEATURE = "geometry struct<type: string, coordinates: string>, _broken string"


def _lines(shape: DataFrame, keep: list[str], box: Box, margin_deg: float) -> DataFrame:
    """Rows of (type, coordinates) to one row per line near the box: `keep`, part, points."""
    kind, coordinates = F.col("type"), F.col("coordinates")
    single = F.array(F.from_json(coordinates, "array<array<double>>"))
    several = F.from_json(coordinates, "array<array<array<double>>>")
    lines = F.when(kind == "LineString", single).when(kind == "MultiLineString", several)
    points = F.transform(
        "line", lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))
    )
    return (
        shape.select(*keep, F.posexplode_outer(lines).alias("part", "line"))
        .select(*keep, "part", points.alias("points"))
        .filter(F.exists("points", lambda p: in_box(p["lat"], p["lon"], box, margin_deg)))
    )


def parse_coastline(
    payloads: DataFrame, text: str = "value", box: Box = REGION, margin_deg: float = LINE_MARGIN_DEG
) -> DataFrame:
    """Feature collections to lines with a point near the region: columns + points[lat, lon].

    Other geometry types are ignored, and so are ordinates past the second. A text that is not JSON
    is an error.
    """
    keep = [c for c in payloads.columns if c != text]
    features = readable(F.col(text), F.from_json(F.col(text), FEATURES)["features"])
    shape = payloads.select(*keep, F.posexplode_outer(features).alias("feature", "f"))
    return _lines(
        shape.select(*keep, "feature", "f.geometry.type", "f.geometry.coordinates"), [*keep, "feature"], box, margin_deg
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    parsed = F.from_json("value", FEATURE, {"columnNameOfCorruptRecord": "_broken"})
    return read_features(spark, path).withColumn("f", parsed).select(
        "file", "feature", "f.geometry.type", "f.geometry.coordinates", F.col("f._broken").isNotNull().alias("broken")
    )


def read_coastline(
    spark: SparkSession, path: str, box: Box = REGION, margin_deg: float = LINE_MARGIN_DEG
) -> DataFrame:
    """Lines of landed GeoJSON collections, on one text line or many: (line_id, points).

    A file is read by as many tasks as it has byte ranges (see `read_features`). The id comes from
    the place of a line in its file, so that it is the same on every reading. Features that are not
    JSON give no lines: `coastline_report` counts them. A file that breaks off is an error.
    """
    lines = _lines(_read(spark, path), ["file", "feature"], box, margin_deg)
    name = F.element_at(F.split("file", "/"), -1)
    return lines.select(F.xxhash64(name, "feature", "part").alias("line_id"), "points")


def coastline_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, features, lines, broken): what a landed collection holds, and how many of its features
    are not JSON."""
    line = F.col("type").isin("LineString", "MultiLineString")
    return _read(spark, path).groupBy("file").agg(
        F.count("*").alias("features"), F.count_if(line).alias("lines"), F.count_if("broken").alias("broken")
    )


def parse_grid_points(payloads: DataFrame, text: str = "value") -> DataFrame:
    """`{"points": [[lat, lon], ...]}` texts to cells rounded to 4 decimals."""
    keep = [c for c in payloads.columns if c != text]
    points = F.from_json(F.col(text), "points array<array<double>>")["points"]
    return payloads.select(*keep, F.explode_outer(points).alias("p")).select(
        *keep,
        grid_cell(F.get("p", F.lit(0))).alias("lat"),
        grid_cell(F.get("p", F.lit(1))).alias("lon"),
    ).dropna(subset=["lat", "lon"])


def read_grid_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_grid_points(spark.read.text(path))
