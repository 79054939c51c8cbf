"""Weights applied to fishing effort."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.constants import (
    BUOYANCY_RATE,
    DEFAULT_GEAR_WEIGHT,
    GEAR_WEIGHTS,
    SEASON_WEIGHTS,
)


def gear_weight(gear: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(GEAR_WEIGHTS.items())))
    return F.coalesce(
        F.try_element_at(known, F.lower(F.trim(gear))), F.lit(DEFAULT_GEAR_WEIGHT)
    )


def season_weight(day: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in SEASON_WEIGHTS)), F.month(day))


def release_scale(day: Column) -> Column:
    return season_weight(day) * BUOYANCY_RATE
