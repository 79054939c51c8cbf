"""Transforms of the risk model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.constants import INDEX_FLOOR, PRIOR_EVENTS, WINDOW_SLOTS


def clamp(value: Column, low: Column | float | int, high: Column | float | int) -> Column:
    """`value` kept within [low, high]; unlike greatest/least, null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def log1p_scaled(value: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.log1p(clamp(value, 0.0, float("inf")) / F.greatest(scale, F.lit(1e-9)))


def logit(chance: Column) -> Column:
    safe = clamp(chance, 1e-9, 1.0 - 1e-9)
    return F.ln(safe / (F.lit(1.0) - safe))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def half_life_decay(days: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(float(half_life_days)))


def poisson_chance(count: Column, years: Column) -> Column:
    rate = (count + PRIOR_EVENTS) / (F.greatest(years, F.lit(1)) * WINDOW_SLOTS)
    return F.lit(1.0) - F.exp(-rate)


def risk_index(probability: Column, low: Column, high: Column) -> Column:
    """0-100, log-spaced between the anchors; flat 0 without a usable pair of anchors."""
    position = (F.ln(clamp(probability, INDEX_FLOOR, float("inf"))) - F.ln(low)) / (
        F.ln(high) - F.ln(low)
    )
    return F.when((high > low) & (low > 0), clamp(position, 0.0, 1.0) * 100.0).otherwise(F.lit(0.0))
