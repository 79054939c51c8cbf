"""The risk model: signals, scores, maps, fitting and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.history import observed
from tidewrack.catalog.registry import AS_OF, FIRST_DAY, LAST_DAY, query
from tidewrack.constants import RIDGE, SIGNALS
from tidewrack.operators import ranking, serving
from tidewrack.operators.history import seasonal_baseline
from tidewrack.plans import evaluation, risk
from tidewrack.session import settled

SIGNAL_SQL = ", ".join(f"round({s}, 6) AS {s}" for s in SIGNALS)
RISK_SQL = f"""SELECT day, segment_id, source, round(probability, 6) AS probability,
    round(seasonal, 6) AS seasonal, {SIGNAL_SQL} FROM """

# A model with every weight in use, for queries that need fitted scores.
FITTED = risk.RiskModel(
    intercept=-1.5,
    weights={"persistence": 0.4, "drift_index": 0.3, "swell_m": -0.2, "wave_m": 0.25,
             "onshore_m": 0.15, "period_s": -0.1},
    scales={"persistence": 0.8, "drift_index": 1.5, "swell_m": 1.2, "wave_m": 2.5,
            "onshore_m": 0.7, "period_s": 8.0},
    seasonal_weight=0.9,
    seasonal_baseline=-2.0,
    fitted=True,
)
SCORED = " + ".join(
    f"{FITTED.weights[s]}e0 * ln(1 + greatest({s}, 0) / {FITTED.scales[s]}e0)" for s in SIGNALS
)
FITTED_SQL = f"""(SELECT * EXCLUDE (probability),
    1 / (1 + exp(-(-1.5e0 + {SCORED} + 0.9e0 * (ln(seasonal / (1 - seasonal)) + 2e0)))) AS probability
  FROM fx_risk)"""


def risk_inputs(spark, folder, history=None):
    return risk.RiskInputs(
        segments=inputs.segments(spark, folder),
        condition=inputs.condition(spark, folder),
        drift=inputs.drift_daily(spark, folder),
        observed=history if history is not None else settled(observed(spark, folder)),
    )


def risk_table(spark, folder, model=None, history=None):
    return risk.risk_days(
        risk_inputs(spark, folder, history), FIRST_DAY, LAST_DAY, AS_OF, model
    )


@query(
    "m1_signals",
    f"SELECT segment_id, day, {SIGNAL_SQL} FROM fx_signal",
)
def signals(spark, folder):
    rows = risk.signals(risk_inputs(spark, folder), FIRST_DAY, LAST_DAY)
    return rows.select("segment_id", "day", *(r6(s) for s in SIGNALS))


@query(
    "m3_design",
    f"""SELECT segment_id, day,
          {", ".join(f"round(ln(1 + greatest({s}, 0) / {FITTED.scales[s]}e0), 6) AS x_{s}" for s in SIGNALS)},
          round(ln(seasonal / (1 - seasonal)) + 2e0, 6) AS x_seasonal FROM fx_risk""",
)
def designed(spark, folder):
    rows = risk.design(risk_table(spark, folder), FITTED)
    return rows.select(
        "segment_id", "day", *(r6(f"x_{s}") for s in SIGNALS), r6("x_seasonal")
    )


@query("m4_score", RISK_SQL + FITTED_SQL)
def scored(spark, folder):
    return _rounded(risk_table(spark, folder, FITTED))


def _rounded(rows):
    return rows.select(
        "day", "segment_id", "source", r6("probability"), r6("seasonal"), *(r6(s) for s in SIGNALS)
    )


@query("m6_risk_days", RISK_SQL + "fx_risk")
def unfitted(spark, folder):
    return _rounded(risk_table(spark, folder))


@query(
    "m6_refresh_risk",
    f"""{RISK_SQL} (SELECT * FROM fx_risk WHERE day NOT BETWEEN date '2001-06-10' AND date '2001-06-12'
          UNION ALL BY NAME SELECT * FROM {FITTED_SQL} WHERE day BETWEEN date '2001-06-10' AND date '2001-06-12')""",
)
def refreshed(spark, folder):
    """Three days scored again with another model, replacing the stored ones."""
    history = settled(observed(spark, folder))
    stored = risk_table(spark, folder, history=history)
    fresh = risk.risk_days(
        risk_inputs(spark, folder, history), "2001-06-10", "2001-06-12", AS_OF, FITTED
    )
    return _rounded(risk.refresh_risk(stored, fresh, "2001-06-10", "2001-06-12"))


@query(
    "j7_label_struck",
    "SELECT day, segment_id, struck FROM fx_labelled",
)
def labelled(spark, folder):
    history = settled(observed(spark, folder))
    return evaluation.label_struck(risk_table(spark, folder, history=history), history).select(
        "day", "segment_id", "struck"
    )


@query(
    "a10_index_anchors",
    f"""SELECT round(quantile_cont(probability, 0.5e0), 9) AS low,
          round(quantile_cont(probability, 0.999e0), 9) AS high FROM {FITTED_SQL}""",
)
def anchors(spark, folder):
    table = settled(risk_table(spark, folder, FITTED))
    return serving.index_anchors(table).select(
        F.round("low", 9).alias("low"), F.round("high", 9).alias("high")
    )


def _map(spark, folder, day="2001-06-20"):
    table = settled(risk_table(spark, folder, FITTED))
    return serving.risk_map(
        inputs.segments(spark, folder), table, serving.index_anchors(table), day
    )


MAP_SQL = f"""(SELECT s.segment_id, center_lat, center_lon, length_km, probability, seasonal, source,
    {", ".join(SIGNALS)},
    100 * greatest(least((ln(greatest(probability, 1e-9)) - ln(low)) / (ln(high) - ln(low)), 1), 0) AS risk_index
  FROM {FITTED_SQL} r JOIN fx_segment s USING (segment_id),
    (SELECT quantile_cont(probability, 0.5e0) AS low, quantile_cont(probability, 0.999e0) AS high FROM {FITTED_SQL})
  WHERE day = date '2001-06-20')"""


@query(
    "j5_risk_map",
    f"""SELECT segment_id, center_lat, center_lon, length_km, round(risk_index, 6) AS risk_index,
          round(probability, 6) AS probability, source FROM {MAP_SQL}""",
)
def mapped(spark, folder):
    return _map(spark, folder).select(
        "segment_id", "center_lat", "center_lon", "length_km", r6("risk_index"), r6("probability"), "source"
    )


@query(
    "t1_top_risk",
    f"""SELECT segment_id, round(probability, 6) AS probability FROM {MAP_SQL}
        ORDER BY probability DESC, segment_id""",
)
def top(spark, folder):
    return serving.top_risk(_map(spark, folder)).select("segment_id", r6("probability"))


@query(
    "s12_to_geojson",
    f"""SELECT segment_id, 'Feature' AS kind, 'LineString' AS shape, center_lon AS first_lon, center_lat AS first_lat,
          round(risk_index, 6) AS risk_index, source FROM {MAP_SQL}""",
)
def features(spark, folder):
    """Feature texts, read back from the JSON they were written as."""
    text = serving.to_geojson(_map(spark, folder))

    def part(path):
        return F.get_json_object("feature", f"$.{path}")

    return text.select(
        "segment_id",
        part("type").alias("kind"),
        part("geometry.type").alias("shape"),
        part("geometry.coordinates[0][0]").cast("double").alias("first_lon"),
        part("geometry.coordinates[0][1]").cast("double").alias("first_lat"),
        r6("risk_index", part("properties.index").cast("double")),
        part("properties.source").alias("source"),
    )


@query(
    "a11_signal_scales",
    "SELECT " + ", ".join(
        f"round(coalesce(avg(CASE WHEN {s} > 0 THEN {s} END), 1), 6) AS {s}" for s in SIGNALS
    ) + " FROM fx_risk",
)
def scales(spark, folder):
    return evaluation.signal_scales(risk_table(spark, folder)).select(*(r6(s) for s in SIGNALS))


@query(
    "t3_balanced_sample",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY struck
              ORDER BY md5(concat('7|', cast(day AS varchar), '|', cast(segment_id AS varchar)))) AS n FROM fx_labelled)
       SELECT day, segment_id, struck FROM ranked
       WHERE struck = 1 OR n <= 2 * (SELECT count(*) FROM fx_labelled WHERE struck = 1)""",
)
def sample(spark, folder):
    history = settled(observed(spark, folder))
    rows = evaluation.label_struck(risk_table(spark, folder, history=history), history)
    chosen = evaluation.balanced_sample(settled(rows), ratio=2, seed=7)
    return chosen.select("day", "segment_id", "struck")


@query(
    "m5_gradient",
    "SELECT unnest(['intercept', " + ", ".join(f"'{s}'" for s in SIGNALS) + ", 'seasonal']) AS name, 0e0 AS gradient",
)
def gradient(spark, folder):
    """The slope of the penalised loss at the fitted coefficients, over the rows they are fitted on."""
    history = settled(observed(spark, folder))
    table = settled(risk_table(spark, folder, history=history))
    base = seasonal_baseline(history, inputs.segments(spark, folder)).first().seasonal_baseline
    labelled = settled(evaluation.label_struck(table, history))
    sample, _ = evaluation.training_sample(labelled, base, 0)
    at = evaluation.ridge_logistic(sample, evaluation.DESIGN).coefficients
    linear = F.lit(at["intercept"])
    for name in evaluation.DESIGN:
        linear = linear + F.col(name) * F.lit(at[name])
    rest = F.col("struck") - 1 / (1 + F.exp(-linear))
    slopes = sample.agg(
        F.sum(rest).alias("intercept"),
        *((F.sum(rest * F.col(n)) - F.lit(RIDGE * at[n])).alias(n.removeprefix("x_")) for n in evaluation.DESIGN),
    )
    names = slopes.columns
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), (F.round(n, 4) + 0.0).alias("gradient")) for n in names))
    return slopes.select(F.inline(pairs))


@query("m5_fit")
def fitted(spark, folder):
    """Coefficients of a model fitted to the stored rows."""
    history = settled(observed(spark, folder))
    table = settled(risk_table(spark, folder, history=history))
    base = seasonal_baseline(history, inputs.segments(spark, folder)).first().seasonal_baseline
    model = evaluation.fit(table, history, base, seed=0)
    return evaluation.model_rows(table, model).select("name", r6("weight"), r6("scale"))


@query(
    "a12_spread",
    f"""WITH daily AS (SELECT day, avg(probability) AS m, stddev_pop(probability) AS s FROM {FITTED_SQL} GROUP BY 1)
        SELECT round(stddev_pop(m), 9) AS between_day, round(avg(s), 9) AS within_day,
          round(CASE WHEN avg(s) > 0 THEN stddev_pop(m) / avg(s) ELSE 0 END, 6) AS ratio FROM daily""",
)
def spreads(spark, folder):
    rows = evaluation.rescored_spread(risk_table(spark, folder), FITTED)
    return rows.select(
        F.round("between_day", 9).alias("between_day"),
        F.round("within_day", 9).alias("within_day"),
        r6("ratio"),
    )


@query(
    "a13_skill",
    """WITH ranked AS (SELECT struck, row_number() OVER (ORDER BY probability, day, segment_id) AS n
              FROM fx_labelled)
       SELECT cast(count(*) AS double) AS rows, sum(struck) AS positives,
         round((sum(n * struck) - sum(struck) * (sum(struck) + 1) / 2) / (sum(struck) * sum(1 - struck)), 6) AS auc
       FROM ranked""",
)
def auc(spark, folder):
    history = settled(observed(spark, folder))
    # Rank what is stored: seasonal chances are equal for many segments.
    return evaluation.skill(risk_table(spark, folder, history=history), history).select(
        "rows", "positives", r6("auc")
    )


@query(
    "w6_ordinal_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         row_number() OVER (ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal
       FROM lineitem""",
)
def ranked(spark, folder):
    """Eleven distinct scores over all line items: equal ones spread over partitions."""
    order = ["l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    items = inputs.table(spark, folder, "lineitem").select(order)
    return ranking.ordinal_rank(items, order).drop("l_discount")
