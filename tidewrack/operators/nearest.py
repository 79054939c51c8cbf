"""Nearest-neighbour joins without comparing every pair.

Sites and points are grouped into the same square tiles, each summarised by a bounding box. Two
boxes give a lower and an upper bound on the distance from any point of the one to the nearest
site of the other; tiles whose lower bound exceeds the best upper bound of a cell of points cannot
win and are dropped before any site is looked at, from coarse tiles to fine ones. The bounds are
exact, so the answer is the true minimum. What is searched is tables of tiles, bounded by the area
and not by the points: a point meets the few sites its cell has left in one row, and no pairs of
points and tiles are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.constants import (
    EARTH_RADIUS_KM,
    KM_PER_LAT_DEG,
    KM_PER_LON_DEG,
    RASTER_COLUMNS,
    RASTER_ROWS,
    RASTER_STEP_DEG,
    REGION,
    SNAP_RADIUS_KM,
)
from tidewrack.functions.geodesy import chord_to_km, half_chord, planar_km
from tidewrack.functions.scoring import clamp
from tidewrack.functions.timeline import utc_day
from tidewrack.session import settled

# Bounds come from the same arithmetic as the distance; the slack covers the last bits.
SLACK = 1.0 + 1e-9
CELL_BOX = ("low_lat", "high_lat", "low_lon", "high_lon")


# Wrapped longitudes are right to some 5e-16: this covers it for boxes too near for the slack.
LEAST = 1e-20

# Sites of a cell that travel in one row.
CHUNK = 1024


def _gap(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The distance of two intervals."""
    return F.greatest(second[0] - first[1], first[0] - second[1], F.lit(0.0))


def _far(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The largest distance of a place in one interval from a place in the other."""
    return F.greatest(first[1] - second[0], second[1] - first[0])


def _planar_square(d_lat: Column, d_lon: Column, cos_site: Column) -> Column:
    north = d_lat * KM_PER_LAT_DEG
    east = d_lon * KM_PER_LON_DEG * cos_site
    return north * north + east * east


def _chord_square(d_lat: Column, d_lon: Column, cos_both: Column) -> Column:
    north = F.sin(F.radians(d_lat) / 2)
    east = F.sin(F.radians(d_lon) / 2)
    return north * north + cos_both * east * east


def _tile(value: Column, tile_deg: float) -> Column:
    return F.floor(value / tile_deg).cast("int")


def _boxes(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of the sites (`site_lat`, `site_lon`) of each tile."""
    return places.groupBy(*keys).agg(
        F.min("site_lat").alias("south"),
        F.max("site_lat").alias("north"),
        F.min("site_lon").alias("west"),
        F.max("site_lon").alias("east"),
    )


def _cells(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of the points of each cell, from those of smaller cells or of points."""
    return places.groupBy(*keys).agg(
        F.min("low_lat").alias("low_lat"),
        F.max("high_lat").alias("high_lat"),
        F.min("low_lon").alias("low_lon"),
        F.max("high_lon").alias("high_lon"),
    )


def _wrapped(lon: Column) -> Column:
    """The same meridian between -180 (inclusive) and 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _bounds(planar: bool) -> tuple[Column, Column]:
    """Lower and upper bound on the measure from any point of a cell to its nearest site of a box."""

    def cosines(low: Column, high: Column) -> tuple[Column, Column]:
        ends = F.cos(F.radians(low)), F.cos(F.radians(high))
        return F.least(*ends), F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(*ends))

    low_lat, high_lat, low_lon, high_lon = (F.col(n) for n in CELL_BOX)
    south, north, west, east = (F.col(n) for n in ("south", "north", "west", "east"))
    least, most = cosines(south, north)
    lats = (low_lat, high_lat), (south, north)
    if planar:
        lons = (low_lon, high_lon), (west, east)
        return _planar_square(_gap(*lats), _gap(*lons), least), _planar_square(_far(*lats), _far(*lons), most)
    # The way round from middle to middle, and half of both widths: both ends within half a turn.
    away = F.abs(_wrapped((low_lon + high_lon) / 2 - (west + east) / 2))
    half = (east - west) / 2 + (high_lon - low_lon) / 2
    here_least, here_most = cosines(low_lat, high_lat)
    return (
        _chord_square(_gap(*lats), F.greatest(away - half, F.lit(0.0)), here_least * least),
        _chord_square(_far(*lats), F.least(away + half, F.lit(180.0)), here_most * most),
    )


def _winnow(
    held: DataFrame, boxes: DataFrame, on: Sequence[str], cell: Sequence[str], keep: Sequence[str], planar: bool, within: Column
) -> DataFrame:
    """Rows of `held` with the boxes that may still hold the nearest site of a point of their cell.

    `held` rows lead to their boxes by the keys `on`. The best upper bound of each cell is found
    first and taken along, so that the pairs themselves are neither gathered nor shuffled.
    """
    lower, upper = _bounds(planar)
    pairs = held.join(boxes, list(on)).withColumn("lower", lower).where(F.col("lower") <= within * SLACK + LEAST)
    ceiling = pairs.groupBy(*cell).agg(F.min(upper).alias("ceiling"))
    return settled(
        held.join(ceiling, list(cell))
        .join(boxes, list(on))
        .withColumn("lower", lower)
        .where(F.col("lower") <= F.least(within, F.col("ceiling")) * SLACK + LEAST)
        .select(*cell, *keep, *CELL_BOX)
    )


def _reach_deg(site_row: Column, point_row: Column, limit_km: float, planar: bool, tile_deg: float) -> Column:
    """Degrees of longitude that the limit spans, at most, between two rows of tiles."""

    def narrowest(row: Column) -> Column:
        edge = F.greatest(F.abs(row * tile_deg), F.abs((row + 1) * tile_deg))
        return F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-12))

    if planar:
        return F.least(F.lit(limit_km / KM_PER_LON_DEG) / narrowest(site_row), F.lit(180.0))
    half = F.lit(sin(min(limit_km / (2 * EARTH_RADIUS_KM), pi / 2)))
    return F.degrees(2 * F.asin(F.least(half / F.sqrt(narrowest(site_row) * narrowest(point_row)), F.lit(1.0))))


def nearest_sites(
    points: DataFrame,
    sites: DataFrame,
    point_key: Sequence[str],
    limit_km: float,
    planar: bool,
    tiles_deg: Sequence[float],
) -> DataFrame:
    """Per point the nearest site within `limit_km`: point_key + (site_id, distance_km).

    `points` has unique `point_key` with columns lat, lon; `sites` has site_id, lat, lon.
    Equal distances go to the lowest site_id. Points with no site in reach are absent.
    `tiles_deg` are tile sizes from coarse to fine: each level looks only inside the tiles
    the one before has left, so a densely populated tile is never compared as a whole.
    Each pair of tile rows has its own reach in longitude, so any latitude may occur; on the
    sphere longitudes wrap at 180 degrees, whose tiles must divide a full turn.
    """
    coarse = tiles_deg[0]
    lat_km = KM_PER_LAT_DEG if planar else 111.19
    rows = ceil(limit_km / (lat_km * coarse))
    turn = round(360.0 / coarse)
    reach = _reach_deg(F.col("row_0"), F.col("at_row_0"), limit_km, planar, coarse)
    columns = F.least(F.ceil(reach / coarse + 1e-9), F.lit(turn // 2)).cast("int")
    levels = range(len(tiles_deg))
    keys = [[f"row_{n}", f"col_{n}"] for n in levels]
    cells = [[f"at_{name}" for name in names] for names in keys]

    def tiles(lat: Column, lon: Column, names: Sequence[Sequence[str]]) -> list[Column]:
        return [
            _tile(value, size).alias(name)
            for pair, size in zip(names, tiles_deg, strict=True)
            for value, name in zip((lat, lon), pair, strict=True)
        ]

    def path(names: Sequence[Sequence[str]], level: int) -> list[str]:
        return [name for pair in names[: level + 1] for name in pair]

    lat, lon = F.col("lat"), F.col("lon") if planar else _wrapped(F.col("lon"))
    placeable = ~F.isnan("lat") & ~F.isnan("lon")
    distinct = settled(
        sites.where(placeable)
        .groupBy("lat", "lon")
        .agg(F.min("site_id").alias("site_id"))
        .select(lat.alias("site_lat"), lon.alias("site_lon"), "site_id", *tiles(lat, lon, keys))
    )
    # Boxes are repeated into the tiles they may matter to, and a cell only looks at its own tile.
    reaching = (
        _boxes(distinct, keys[0])
        .withColumn("_shift", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
        .withColumn("at_row_0", F.col("row_0") + F.col("_shift"))
        .withColumn("_columns", columns)
        .withColumn(
            "_shift", F.explode(F.sequence(-F.col("_columns"), F.least("_columns", turn - 1 - F.col("_columns"))))
        )
        .withColumn("at_col_0", F.col("col_0") + F.col("_shift"))
        .drop("_shift", "_columns")
    )
    if not planar:
        half = turn // 2
        reaching = reaching.withColumn("at_col_0", F.pmod(F.col("at_col_0") + half, F.lit(turn)) - half)
    placed = points.where(placeable).select(
        *point_key, lat.alias("_lat"), F.col("lon").alias("_lon"), *tiles(lat, lon, cells)
    )
    own = placed.select(
        *path(cells, levels[-1]), *(F.col("_lat").alias(n) for n in CELL_BOX[:2]),
        *((F.col("_lon") if planar else _wrapped(F.col("_lon"))).alias(n) for n in CELL_BOX[2:]),
    )
    finest = settled(_cells(own, path(cells, levels[-1])))
    within = (
        F.lit(limit_km * limit_km)
        if planar
        else F.pow(F.sin(F.lit(min(limit_km / (2 * EARTH_RADIUS_KM), pi / 2))), F.lit(2.0))
    )

    best = _winnow(_cells(finest, cells[0]), reaching, cells[0], cells[0], keys[0], planar, within)
    for level in levels[1:]:
        # Smaller cells among the tiles their larger one has left, then the smaller tiles of those.
        inner, outer = path(cells, level), path(cells, level - 1)
        beside = best.drop(*CELL_BOX).join(_boxes(distinct, path(keys, level - 1)), path(keys, level - 1))
        best = _winnow(_cells(finest, inner), beside, outer, inner, path(keys, level - 1), planar, within)
        best = _winnow(best, _boxes(distinct, path(keys, level)), path(keys, level - 1), inner, path(keys, level), planar, within)
    cell, tile = path(cells, levels[-1]), path(keys, levels[-1])
    single = distinct.select(
        *tile, "site_lat", "site_lon", "site_id", *(F.col("site_lat").alias(n) for n in ("south", "north")),
        *(F.col("site_lon").alias(n) for n in ("west", "east")),
    )
    left = _winnow(best, single, tile, cell, ["site_lat", "site_lon", "site_id"], planar, within)
    numbered = F.row_number().over(Window.partitionBy(*cell).orderBy("site_lat", "site_lon"))
    chunks = (
        left.withColumn("_chunk", F.floor(numbered / CHUNK))
        .groupBy(*cell, "_chunk")
        .agg(F.collect_list(F.struct("site_lat", "site_lon", "site_id")).alias("_sites"))
    )

    def measured(site: Column) -> Column:
        place = (F.col("_lat"), F.col("_lon"), site["site_lat"], site["site_lon"])
        measure = planar_km(*place) if planar else half_chord(*place)
        return F.struct(measure.alias("measure"), site["site_id"].alias("site_id"))

    found = (
        placed.join(chunks, cell)
        .select(*point_key, F.array_min(F.transform("_sites", measured)).alias("best"))
        .groupBy(*point_key)
        .agg(F.min("best").alias("best"))
    )
    distance = F.col("best.measure") if planar else chord_to_km(F.col("best.measure"))
    return found.select(
        *point_key, F.col("best.site_id").alias("site_id"), distance.alias("distance_km")
    ).filter(F.col("distance_km") <= limit_km)


def raster_node(df: DataFrame) -> DataFrame:
    """Adds the raster node of (lat, lon): rounded half-even, clipped to the region's edge."""

    def index(value: Column, origin: float, count: int) -> Column:
        step = F.rint((value - origin) / RASTER_STEP_DEG)
        return clamp(step, 0.0, float(count - 1)).cast("int")

    return df.withColumn(
        "node_row", index(F.col("lat"), REGION.min_lat, RASTER_ROWS)
    ).withColumn("node_col", index(F.col("lon"), REGION.min_lon, RASTER_COLUMNS))


def node_position(row: Column, column: Column) -> tuple[Column, Column]:
    lat = F.lit(REGION.min_lat) + row.cast("double") * RASTER_STEP_DEG
    lon = F.lit(REGION.min_lon) + column.cast("double") * RASTER_STEP_DEG
    return lat, lon


def coast_raster(segment_points: DataFrame, radius_km: float = SNAP_RADIUS_KM) -> DataFrame:
    """(node_row, node_col, segment_id, distance_km) of every raster node near a segment.

    It depends on the coastline only and never has more rows than the raster has nodes.
    `sources.rasters` keeps it stored.
    """
    nodes = segment_points.sparkSession.range(RASTER_ROWS * RASTER_COLUMNS).select(
        F.floor(F.col("id") / RASTER_COLUMNS).cast("int").alias("node_row"),
        (F.col("id") % RASTER_COLUMNS).cast("int").alias("node_col"),
    )
    return nearest_nodes(nodes, segment_points, radius_km)


def nearest_nodes(nodes: DataFrame, segment_points: DataFrame, radius_km: float) -> DataFrame:
    """The rows of `coast_raster` for some nodes (node_row, node_col)."""
    lat, lon = node_position(F.col("node_row"), F.col("node_col"))
    return nearest_sites(
        nodes.select("node_row", "node_col", lat.alias("lat"), lon.alias("lon")),
        segment_points.select(F.col("segment_id").alias("site_id"), "lat", "lon"),
        ["node_row", "node_col"],
        limit_km=radius_km,
        planar=True,
        tiles_deg=(0.1, 0.02),
    ).withColumnRenamed("site_id", "segment_id")


def snap_to_segment(events: DataFrame, raster: DataFrame) -> DataFrame:
    """Events plus (segment_id, distance_km) of the nearest segment within the radius.

    Distances are measured from the raster node of the event. The raster is bounded (some
    370,000 short rows at most), so it is broadcast and the events are not shuffled at all.
    """
    return (
        raster_node(events)
        .join(F.broadcast(raster), ["node_row", "node_col"])
        .drop("node_row", "node_col")
    )


def observed_strandings(strandings: DataFrame, raster: DataFrame) -> DataFrame:
    """Records per (segment_id, day): the form every history operator starts from."""
    return (
        snap_to_segment(strandings, raster)
        .groupBy("segment_id", utc_day(F.col("recorded_at")).alias("day"))
        .agg(F.count("*").alias("records"))
    )


def nearest_within(points: DataFrame, sites: DataFrame, limit_km: float) -> DataFrame:
    """Every point with the great-circle distance to its nearest site, null beyond the limit.

    The search runs once per distinct position, however many points share it.
    """
    found = nearest_sites(
        points.select("lat", "lon").distinct(),
        sites.select(F.lit(0).alias("site_id"), "lat", "lon"),
        ["lat", "lon"],
        limit_km=limit_km,
        planar=False,
        tiles_deg=(0.5, 0.1, 0.02),
    )
    return points.join(found.drop("site_id"), ["lat", "lon"], "left")
