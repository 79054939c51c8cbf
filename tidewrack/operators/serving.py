"""Queries that serve stored tables: snapshots, maps, matrices, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.constants import INDEX_QUANTILES, SIGNALS
from tidewrack.functions.scoring import risk_index
from tidewrack.operators.ranking import exact_quantiles
from tidewrack.sources.tables import scan_span

# The field names of the served records, and the columns of each map layer.
VESSEL_FIELDS = (
    "mmsi", "lat", "lon", "ship_name", "flag", "gear_type", "vessel_type",
    "effort_hours", "recorded_at", "source",
)
STRANDING_FIELDS = (
    "lat", "lon", "species_scientific", "species_common", "individual_count", "recorded_at",
    "time_uncertainty_hours", "coordinate_uncertainty_m", "location_precision", "source",
    "external_id",
)
# layer -> (speed, direction, further fields)
LAYERS = {
    "wind": ("wind_speed_kmh", "wind_direction_deg", ()),
    "currents": ("current_speed_kmh", "current_direction_deg", ()),
    "sea": (
        "wave_height_m",
        "wave_direction_deg",
        (
            "wave_period_s", "swell_height_m", "swell_direction_deg", "swell_period_s",
            "sea_surface_temperature_c", "sea_level_m", "forecast",
        ),
    ),
}


def at_hour(df: DataFrame, instant_column: str, instant: str, fields: Sequence[str]) -> DataFrame:
    """Rows of the hour that holds `instant` (UTC text)."""
    start = F.date_trunc("hour", F.lit(instant).cast("timestamp"))
    end = start + F.expr("INTERVAL 1 HOUR")
    kept = [name for name in fields if name in df.columns]
    kind = df.schema[instant_column].dataType
    return scan_span(df, instant_column, start.cast(kind), end.cast(kind)).select(*kept)


def strandings_on(df: DataFrame, day: str) -> DataFrame:
    kind = df.schema["recorded_at"].dataType
    start = F.lit(day).cast("date")
    kept = [name for name in STRANDING_FIELDS if name in df.columns]
    return scan_span(
        df, "recorded_at", start.cast(kind), F.date_add(start, 1).cast(kind)
    ).select(*kept)


def condition_layer(df: DataFrame, layer: str) -> DataFrame:
    """The cells one map layer can draw: both speed and direction known."""
    speed, direction, more = LAYERS[layer]
    return df.filter(F.col(speed).isNotNull() & F.col(direction).isNotNull()).select(
        "lat", "lon", speed, direction, *more
    )


def monthly_matrix(strandings: DataFrame) -> DataFrame:
    """Individuals per year and month; months past the last reported one are null."""
    months = list(range(1, 13))
    names = [f"m{m:02d}" for m in months]
    by_year = (
        strandings.select(
            F.year("recorded_at").alias("year"),
            F.month("recorded_at").alias("month"),
            "individual_count",
        )
        .groupBy("year")
        .pivot("month", months)
        .agg(F.sum("individual_count"))
        .withColumnsRenamed({str(m): name for m, name in zip(months, names, strict=True)})
    )
    # One row per year from here on.
    is_latest = F.row_number().over(Window.orderBy(F.desc("year"))) == 1
    last_month = F.greatest(
        *(F.when(F.col(name).isNotNull(), F.lit(m)) for m, name in zip(months, names, strict=True))
    )
    marked = by_year.withColumn("_latest", is_latest).withColumn("_last", last_month)
    return marked.select(
        "year",
        *(
            F.when(F.col("_latest") & (F.lit(m) > F.col("_last")), F.lit(None).cast("double"))
            .otherwise(F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
            .alias(name)
            for m, name in zip(months, names, strict=True)
        ),
    )


def time_range(condition: DataFrame, vessels: DataFrame) -> DataFrame:
    """Earliest and latest instant over both tables; null when both are empty."""
    bounds = condition.agg(
        F.min("valid_at").alias("lo"), F.max("valid_at").alias("hi")
    ).unionByName(vessels.agg(F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi")))
    return bounds.agg(F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))


def index_anchors(risk: DataFrame) -> DataFrame:
    """One row (low, high): the probabilities that stand for 0 and 100, over the whole table."""
    low, high = INDEX_QUANTILES
    found = exact_quantiles(risk, "probability", INDEX_QUANTILES)
    picked = found.agg(
        F.coalesce(F.max(F.when(F.col("q") == low, F.col("value"))), F.lit(0.0)).alias("low"),
        F.coalesce(F.max(F.when(F.col("q") == high, F.col("value"))), F.lit(0.0)).alias("high"),
    )
    return picked


def with_index(risk: DataFrame, anchors: DataFrame) -> DataFrame:
    pair = anchors.agg(F.first(F.struct("low", "high"))).scalar()
    return (
        risk.withColumn("_anchors", pair)
        .withColumn(
            "risk_index",
            risk_index(F.col("probability"), F.col("_anchors.low"), F.col("_anchors.high")),
        )
        .drop("_anchors")
    )


def risk_map(segments: DataFrame, risk: DataFrame, anchors: DataFrame, day: Column | str) -> DataFrame:
    """Scored segments of one day with their map index."""
    wanted = F.lit(day).cast("date") if isinstance(day, str) else day
    carried = [c for c in ("center_lat", "center_lon", "length_km", "path") if c in segments.columns]
    scored = risk.filter(F.col("day") == wanted).join(
        segments.select("segment_id", *carried), "segment_id"
    )
    return with_index(scored, anchors).select(
        "segment_id", *carried, "risk_index", "probability", "seasonal", "source", *SIGNALS
    )


def top_risk(risk_map_rows: DataFrame, count: int | None = None) -> DataFrame:
    """Highest probability first; equal ones by segment. With `count`, only the first ones."""
    ranked = risk_map_rows.orderBy(F.desc("probability"), "segment_id")
    return ranked if count is None else ranked.limit(count)


def to_geojson(risk_map_rows: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per segment, for line-delimited output of any size."""
    center = F.array(F.array("center_lon", "center_lat"))
    if "path" in risk_map_rows.columns:
        line = F.transform("path", lambda p: F.array(p["lon"], p["lat"]))
        coordinates = F.coalesce(line, center)
    else:
        coordinates = center
    properties = F.struct(
        "segment_id",
        F.col("center_lat").alias("lat"),
        F.col("center_lon").alias("lon"),
        "length_km",
        F.col("risk_index").alias("index"),
        "probability",
        "seasonal",
        "source",
        *SIGNALS,
    )
    geometry = F.struct(
        F.lit("LineString").alias("type"), coordinates.alias("coordinates")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")
    )
    return risk_map_rows.select("segment_id", F.to_json(feature).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    features.select(F.col("feature").alias("value")).write.text(path)
