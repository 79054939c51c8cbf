"""Signals, seasonal chance and probability per segment and day, for a whole span at once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.constants import DRIFT_WINDOW_DAYS, SEA_LAG_DAYS, SIGNALS
from tidewrack.functions.geodesy import onshore_component
from tidewrack.functions.scoring import log1p_scaled, logit, sigmoid
from tidewrack.functions.timeline import event_slot, risk_source
from tidewrack.operators.history import (
    all_years_sum,
    circular_window_sum,
    climatology_counts,
    gathered,
    in_windows_of,
    leave_one_year_out,
    persistence,
    with_seasonal,
)
from tidewrack.operators.kernel import kernel_means
from tidewrack.operators.merging import replace_scope
from tidewrack.operators.sea import SEA_VALUES, daily_sea_state, drift_recent
from tidewrack.session import settled
from tidewrack.sources.tables import scan_span


@dataclass(frozen=True)
class RiskModel:
    """Coefficients; they enter plans as literals. Unfitted, the seasonal chance stands.

    The field names are those of the model file: fixed values.
    """

    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 0.0))
    scales: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SIGNALS, 1.0))
    seasonal_weight: float = 0.0
    seasonal_baseline: float = 0.0
    fitted: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> RiskModel:
        return cls(**json.loads(text))


@dataclass(frozen=True)
class RiskInputs:
    segments: DataFrame
    condition: DataFrame
    drift: DataFrame
    observed: DataFrame


def days_between(start: str, end: str) -> Column:
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))


def slots_between(calendar: DataFrame) -> DataFrame:
    """(slot): the slots of the year that the days of a calendar fall on."""
    return calendar.select(event_slot(F.col("day")).alias("slot")).distinct()


def lagged_sea(inputs: RiskInputs, start: str, end: str) -> DataFrame:
    """Daily sea state of each cell, under the days of the span that it is used for."""
    lag = F.expr(f"INTERVAL {SEA_LAG_DAYS} DAYS")
    kind = inputs.condition.schema["valid_at"].dataType
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    seen = scan_span(
        inputs.condition,
        "valid_at",
        (first - lag).cast(kind),
        (F.date_add(last, 1) - lag).cast(kind),
    )
    return daily_sea_state(seen).withColumn("day", F.date_add("day", SEA_LAG_DAYS))


def unscored_days(inputs: RiskInputs, start: str, end: str) -> DataFrame:
    """(day): the days of the span that have no sea state, so `signals` gives no rows for them."""
    asked = inputs.condition.sparkSession.range(1).select(F.explode(days_between(start, end)).alias("day"))
    scored = lagged_sea(inputs, start, end).select("day").distinct()
    return asked.join(F.broadcast(scored), "day", "left_anti")


def signals(inputs: RiskInputs, start: str, end: str) -> DataFrame:
    """One row per segment and day of the span that has sea state (see `unscored_days`): the six signals.

    Every input is cut to the days it can influence before any join; the day-level joins
    all use (segment_id, day), so the spine is shuffled once. The daily sea state is written
    once and read for both the days and the means.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    sea = settled(lagged_sea(inputs, start, end))
    means = kernel_means(inputs.segments, sea, SEA_VALUES)
    # Bounded by the days of the span.
    scored_days = F.broadcast(sea.select("day").distinct())
    spine = inputs.segments.select(
        "segment_id",
        "center_lat",
        "center_lon",
        "orientation_deg",
        F.explode(days_between(start, end)).alias("day"),
    ).join(scored_days, "day", "left_semi")
    drifted = drift_recent(
        inputs.drift.filter(
            F.col("day").between(F.date_sub(first, DRIFT_WINDOW_DAYS), last)
        )
    )
    east, north = (F.coalesce(c, F.lit(0.0)) for c in ("east_m", "north_m"))
    return (
        persistence(gathered(inputs.observed, first, last), spine)
        .join(drifted, ["segment_id", "day"], "left")
        .join(means, ["center_lat", "center_lon", "day"], "left")
        .select(
            "segment_id",
            "day",
            "persistence",
            *(
                F.coalesce(name, F.lit(0.0)).alias(name)
                for name in ("drift_index", "swell_m", "wave_m")
            ),
            onshore_component(east, north, F.col("orientation_deg")).alias("onshore_m"),
            F.coalesce("period_s", F.lit(0.0)).alias("period_s"),
        )
    )


def seasonal(spine: DataFrame, observed: DataFrame, start: str, end: str) -> DataFrame:
    """`spine` (segment_id, day, ...) plus the chance from all years but the day's own."""
    calendar = spine.sparkSession.range(1).select(F.explode(days_between(start, end)).alias("day"))
    slots = slots_between(calendar)
    counts = climatology_counts(in_windows_of(observed, slots))
    held_out = leave_one_year_out(circular_window_sum(counts, slots), calendar, all_years_sum(counts, slots))
    return with_seasonal(spine, held_out, observed)


def design(scored: DataFrame, model: RiskModel) -> DataFrame:
    """Adds the model's columns x_<signal> and x_seasonal."""
    columns = {
        f"x_{name}": log1p_scaled(F.col(name), model.scales[name]) for name in SIGNALS
    }
    columns["x_seasonal"] = logit(F.col("seasonal")) - F.lit(model.seasonal_baseline)
    return scored.withColumns(columns)


def probability(model: RiskModel) -> Column:
    """Probability from designed columns; the seasonal chance while the model is unfitted."""
    if not model.fitted:
        return F.col("seasonal")
    score = F.lit(model.intercept)
    for name in SIGNALS:
        score = score + F.col(f"x_{name}") * model.weights[name]
    return sigmoid(score + F.col("x_seasonal") * model.seasonal_weight)


def score(scored: DataFrame, model: RiskModel) -> DataFrame:
    kept = [c for c in scored.columns if c != "probability"]
    return (
        design(scored, model).withColumn("probability", probability(model)).select(*kept, "probability")
    )


def risk_days(
    inputs: RiskInputs, start: str, end: str, as_of: str, model: RiskModel | None = None
) -> DataFrame:
    """segment_risk rows of every day in [start, end] that has its sea state."""
    measured = signals(inputs, start, end)
    with_season = seasonal(measured, inputs.observed, start, end)
    return score(with_season, model or RiskModel()).select(
        "day",
        "segment_id",
        risk_source(F.col("day"), F.lit(as_of).cast("date")).alias("source"),
        "probability",
        "seasonal",
        *SIGNALS,
    )


def refresh_risk(stored: DataFrame, fresh: DataFrame, start: str, end: str) -> DataFrame:
    """The stored table with the span's days replaced by `fresh`."""
    scope = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return replace_scope(stored, fresh, scope)
