"""Stranding records: occurrence JSON pages and tab-separated event text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import (
    COMMUNE_UNCERTAINTY_M,
    DAY_UNCERTAINTY_HOURS,
    GBIF,
    PELAGIS,
    REGION,
    Box,
)
from tidewrack.functions.geodesy import in_box
from tidewrack.functions.labels import coordinate_text, identity_hash, readable
from tidewrack.functions.timeline import event_window, utc_instant
from tidewrack.operators.ranking import ordinal_in_group
from tidewrack.operators.species import with_common_name, with_scientific_name

STRANDING_COLUMNS = (
    "external_id", "source", "recorded_at", "lat", "lon", "species_scientific",
    "species_common", "individual_count", "coordinate_uncertainty_m",
    "time_uncertainty_hours", "location_precision",
)
PAGE = (
    "results array<struct<key: string, decimalLatitude: double, decimalLongitude: double,"
    " eventDate: string, species: string, scientificName: string, individualCount: int,"
    " coordinateUncertaintyInMeters: double>>"
)
# date / count / label / place (fixed pattern)
EVENT_LINE = r"^\s*(\d{4}-\d{2}-\d{2})\s*/\s*(\d+)\s*/\s*([^/]+?)\s*/\s*(.+?)\s*$"


def parse_occurrences(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Occurrence pages to strandings; records without place or a usable date are dropped.

    A page that is not JSON is an error.
    """
    results = readable(F.col(text), F.from_json(F.col(text), PAGE)["results"])
    occurrence = payloads.select(F.explode_outer(results).alias("o")).select("o.*")
    dated = (
        occurrence.dropna(subset=["decimalLatitude", "decimalLongitude", "eventDate"])
        .withColumn("w", event_window(F.col("eventDate")))
        .filter(F.col("w").isNotNull())
    )
    name = F.coalesce(F.nullif("species", F.lit("")), F.col("scientificName"))
    return with_common_name(dated, name).select(
        F.col("key").alias("external_id"),
        F.lit(GBIF).alias("source"),
        "w.recorded_at",
        F.col("decimalLatitude").alias("lat"),
        F.col("decimalLongitude").alias("lon"),
        "species_scientific",
        "species_common",
        F.coalesce("individualCount", F.lit(1)).alias("individual_count"),
        F.col("coordinateUncertaintyInMeters").alias("coordinate_uncertainty_m"),
        F.col("w.half_width_hours").alias("time_uncertainty_hours"),
        F.lit("gbif_reported").alias("location_precision"),
    )


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return parse_occurrences(spark.read.text(path))


def parse_event_text(lines: DataFrame, chunk: list[str], order: list[str], box: Box = REGION) -> DataFrame:
    """Lines with text fields lon, lat, events to strandings.

    `chunk` and `order` name the columns that give the place of a line in its input (see
    `ordinal_in_group`): repeats of one event are told apart by their order of appearance.
    """
    placed = (
        lines.withColumn("lon", F.trim("lon").try_cast("double"))
        .withColumn("lat", F.trim("lat").try_cast("double"))
        .filter(in_box(F.col("lat"), F.col("lon"), box))
    )
    events = placed.select(
        *chunk, *order, "lat", "lon", F.posexplode_outer(F.split("events", "<br>")).alias("nth", "event")
    ).filter(F.col("event").rlike(EVENT_LINE))
    groups = {name: F.regexp_extract("event", EVENT_LINE, i) for i, name in
              enumerate(("day", "count", "label", "place"), start=1)}
    named = with_scientific_name(
        events.withColumns(groups), F.col("label")
    ).withColumn("commune", F.trim(F.substring_index("place", ",", 1)))
    key = ["lat", "lon", "day", "species_common", "commune"]
    numbered = ordinal_in_group(named, key, chunk, [*order, "nth"], "repeat")
    payload = F.concat_ws(
        "|",
        coordinate_text(F.col("lat")),
        coordinate_text(F.col("lon")),
        "day",
        "species_common",
        "commune",
        F.col("repeat").cast("string"),
    )
    noon = F.timestamp_micros(
        F.unix_micros(utc_instant(F.col("day"))) + F.lit(int(DAY_UNCERTAINTY_HOURS * 3_600_000_000))
    )
    return numbered.select(
        identity_hash(payload).alias("external_id"),
        F.lit(PELAGIS).alias("source"),
        noon.alias("recorded_at"),
        "lat",
        "lon",
        "species_scientific",
        "species_common",
        F.col("count").cast("int").alias("individual_count"),
        F.lit(COMMUNE_UNCERTAINTY_M).alias("coordinate_uncertainty_m"),
        F.lit(DAY_UNCERTAINTY_HOURS).alias("time_uncertainty_hours"),
        F.lit("commune_centroid").alias("location_precision"),
    )


def read_event_text(spark: SparkSession, path: str, box: Box = REGION) -> DataFrame:
    """Tab-separated files with a header; short lines and bad numbers are skipped.

    A file split is the bounded run of lines; its path, offset and row order place a line.
    """
    lines = (
        spark.read.schema("lon string, lat string, name string, events string")
        .option("header", True)
        .option("sep", "\t")
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select(
            "lon",
            "lat",
            "events",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("line", F.monotonically_increasing_id())
        .filter(F.col("events").isNotNull())
    )
    return parse_event_text(lines, ["file", "block"], ["line"], box)
