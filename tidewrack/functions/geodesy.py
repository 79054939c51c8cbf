"""Distances, bearings, boxes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.constants import (
    COORD_DECIMALS,
    EARTH_RADIUS_KM,
    KM_PER_LAT_DEG,
    KM_PER_LON_DEG,
    Box,
)


def in_box(lat: Column, lon: Column, box: Box, margin_deg: float = 0.0) -> Column:
    """Inclusive containment, optionally widened on every side."""
    return lat.between(box.min_lat - margin_deg, box.max_lat + margin_deg) & lon.between(
        box.min_lon - margin_deg, box.max_lon + margin_deg
    )


def grid_cell(value: Column) -> Column:
    return F.round(value, COORD_DECIMALS)


def half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared half chord of the great circle: monotone in the distance."""
    d_lat = F.sin(F.radians(lat2 - lat1) / 2)
    d_lon = F.sin(F.radians(lon2 - lon1) / 2)
    return d_lat * d_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * d_lon * d_lon


def chord_to_km(chord: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return chord_to_km(half_chord(lat1, lon1, lat2, lon2))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular bearing in [0, 360)."""
    east = F.cos(F.radians((lat1 + lat2) / 2)) * (lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)), F.lit(360.0))


def planar_km(lat: Column, lon: Column, coast_lat: Column, coast_lon: Column) -> Column:
    """Flat distance whose longitude scale is taken at the coast point."""
    return F.hypot(
        (lat - coast_lat) * KM_PER_LAT_DEG,
        (lon - coast_lon) * KM_PER_LON_DEG * F.cos(F.radians(coast_lat)),
    )


def polar_to_uv(
    speed_kmh: Column, direction_deg: Column, blows_from: bool
) -> tuple[Column, Column]:
    """Speed (km/h) and compass direction to (east, north) in m/s; unknown parts count as 0.

    Winds and waves are reported by where they come from, currents by where they go.
    """
    speed = F.coalesce(speed_kmh, F.lit(0.0)) / 3.6
    turn = 180.0 if blows_from else 0.0
    heading = F.radians(F.coalesce(direction_deg, F.lit(0.0)) + turn)
    return speed * F.sin(heading), speed * F.cos(heading)


def onshore_component(east: Column, north: Column, orientation_deg: Column) -> Column:
    """Size of the push square-on to a shore; an unknown orientation counts as 0."""
    normal = F.radians(F.coalesce(orientation_deg, F.lit(0.0)) + 90.0)
    return F.abs(east * F.sin(normal) + north * F.cos(normal))
