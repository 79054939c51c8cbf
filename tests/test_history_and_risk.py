import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.constants import SIGNALS
from tidewrack.operators import history, ranking, sea, serving
from tidewrack.plans import evaluation
from tidewrack.plans.risk import RiskModel, slots_between
from tidewrack.sources import masses

OBSERVED = "segment_id int, day date, records int"


def observed_rows(seed=4, segments=4, count=300):
    rng = random.Random(seed)
    rows = {}
    for _ in range(count):
        # one segment holds most records
        key = (0 if rng.random() < 0.6 else rng.randrange(segments),
               date(2019, 1, 1) + timedelta(days=rng.randrange(4 * 365)))
        rows[key] = rows.get(key, 0) + rng.randrange(1, 3)
    return [(s, d, n) for (s, d), n in sorted(rows.items())]


def test_persistence_equals_the_direct_sum(spark):
    rows = observed_rows()
    days = [date(2020, 12, 20) + timedelta(days=i) for i in range(60)]
    spine = spark.createDataFrame([(s, d, s * 10) for s in range(5) for d in days], "segment_id int, day date, extra int")
    got = history.persistence(spark.createDataFrame(rows, OBSERVED), spine).collect()
    assert len(got) == 5 * 60 and all(r.extra == r.segment_id * 10 for r in got)
    for r in got:
        cutoff = r.day - timedelta(days=3)
        want = sum(n * 0.5 ** ((cutoff - d).days / 365) for s, d, n in rows if s == r.segment_id and d < cutoff)
        assert r.persistence == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_records_at_the_issue_lag_do_not_count_yet(spark):
    day = date(2024, 5, 10)
    spine = spark.createDataFrame([(1, day)], "segment_id int, day date")
    seen = spark.createDataFrame([(1, day - timedelta(days=3), 5), (1, day - timedelta(days=4), 1)], OBSERVED)
    assert history.persistence(seen, spine).first().persistence == pytest.approx(0.5 ** (1 / 365))


def slot(day):
    return (date(2000, day.month, day.day) - date(2000, 1, 1)).days


def near(a, b):
    return min((a - b) % 366, (b - a) % 366) <= 15


def test_seasonal_chance_equals_brute_force(spark):
    rows = observed_rows(seed=8)
    days = [date(2020, 12, 25) + timedelta(days=i) for i in range(27)]
    observed = spark.createDataFrame(rows, OBSERVED)
    spine = spark.createDataFrame([(s, d) for s in range(5) for d in days], "segment_id int, day date")
    calendar = spine.select("day").distinct()
    sums = history.circular_window_sum(history.climatology_counts(observed), slots_between(calendar))
    held = history.leave_one_year_out(sums, calendar)
    years = {d.year for _, d, _ in rows}
    for r in history.with_seasonal(spine, held, observed).collect():
        count = sum(n for s, d, n in rows if s == r.segment_id and d.year != r.day.year and near(slot(d), slot(r.day)))
        divisor = max(len(years) - (r.day.year in years), 1)
        assert r.seasonal == pytest.approx(1 - math.exp(-(count + 0.5) / (divisor * 31)))


def test_seasonal_chance_over_three_years_keeps_29_february(spark):
    from tidewrack.plans.risk import seasonal

    rows = [(1, date(2002, 3, 1), 2), (1, date(2004, 2, 20), 5), (1, date(2003, 12, 30), 1), (2, date(2001, 2, 14), 3)]
    observed = spark.createDataFrame(rows, OBSERVED)
    days = [date(2001, 3, 1) + timedelta(days=i) for i in range((date(2004, 3, 1) - date(2001, 3, 1)).days + 1)]
    spine = spark.createDataFrame([(s, d) for s in (1, 2, 3) for d in days], "segment_id int, day date")
    years = {d.year for _, d, _ in rows}
    got = seasonal(spine, observed, "2001-03-01", "2004-03-01").collect()
    assert len(got) == 3 * len(days)
    for r in got:
        count = sum(n for s, d, n in rows if s == r.segment_id and d.year != r.day.year and near(slot(d), slot(r.day)))
        divisor = max(len(years) - (r.day.year in years), 1)
        assert r.seasonal == pytest.approx(1 - math.exp(-(count + 0.5) / (divisor * 31))), r
    leap = next(r for r in got if r.day == date(2004, 2, 29) and r.segment_id == 1)
    assert leap.seasonal > 0.01


def test_only_year_scored_against_itself_has_nothing_left(spark):
    observed = spark.createDataFrame([(1, date(2020, 6, 1), 4)], OBSERVED)
    spine = spark.createDataFrame([(1, date(2020, 6, 2))], "segment_id int, day date")
    sums = history.circular_window_sum(history.climatology_counts(observed))
    held = history.leave_one_year_out(sums, spine.select("day"))
    got = history.with_seasonal(spine, held, observed).first().seasonal
    assert got == pytest.approx(1 - math.exp(-0.5 / 31))


def test_thirty_daily_updates_equal_one_full_run(spark, tmp_path):
    rng, start, path = random.Random(8), date(2024, 1, 1), str(tmp_path / "mass")
    days = {(rng.randrange(6), start + timedelta(days=rng.randrange(-400, 40))): rng.randint(1, 4) for _ in range(150)}
    rows = [(s, d, n) for (s, d), n in days.items()]
    observed = spark.createDataFrame(rows, OBSERVED)
    segments = spark.createDataFrame([(s,) for s in range(7)], "segment_id long")

    def want(day, known=rows):
        out = {}
        for s in range(7):
            out[s] = sum(n * 0.5 ** (((day - timedelta(days=3)) - d).days / 365) for q, d, n in known
                         if q == s and d < day - timedelta(days=3))
        return out

    def run(day, records):
        return {r.segment_id: r.persistence for r in masses.daily_persistence(spark, path, records, segments, day).collect()}

    for n in range(30):
        day = start + timedelta(days=n)
        # Only what came since the day before is there to read.
        since = observed.where(F.col("day") >= F.lit(day - timedelta(days=4))) if n else observed
        assert run(day, since) == pytest.approx(want(day))
        assert run(day, observed.limit(0)) == pytest.approx(want(day))  # again, from what is stored
    late = [(2, start + timedelta(days=10), 5)]
    masses.forget_from(spark, path, start + timedelta(days=10))
    masses.forget_from(spark, path, start + timedelta(days=10))
    assert max(masses.stored_through(spark, path)) == start + timedelta(days=10)
    both = observed.unionByName(spark.createDataFrame(late, OBSERVED))
    day = start + timedelta(days=29)
    assert run(day, both.where(F.col("day") >= F.lit(start + timedelta(days=10)))) == pytest.approx(want(day, rows + late))


def test_window_wraps_inside_its_year(spark):
    counts = spark.createDataFrame([(1, 2023, 365, 1)], "segment_id int, year int, slot int, records int")
    slots = sorted(r.slot for r in history.circular_window_sum(counts).collect())
    assert slots == list(range(15)) + list(range(350, 366))


def test_baseline_equals_the_dense_mean_and_handles_no_records(spark):
    segments = spark.createDataFrame([(i,) for i in range(5)], "segment_id int")
    rows = observed_rows(seed=2, count=40)
    got = history.seasonal_baseline(spark.createDataFrame(rows, OBSERVED), segments).first()[0]
    years = len({d.year for _, d, _ in rows})
    logits = []
    for s in range(5):
        for k in range(366):
            count = sum(n for q, d, n in rows if q == s and near(slot(d), k))
            p = 1 - math.exp(-(count + 0.5) / (years * 31))
            logits.append(math.log(p / (1 - p)))
    assert got == pytest.approx(sum(logits) / len(logits))
    p = 1 - math.exp(-0.5 / 31)
    none = history.seasonal_baseline(spark.createDataFrame([], OBSERVED), segments).first()[0]
    assert none == pytest.approx(math.log(p / (1 - p)))


def test_drift_window_takes_four_landing_days(spark):
    day = date(2024, 3, 10)
    rows = [(day - timedelta(days=d), day - timedelta(days=d), 1, 10.0**d) for d in (0, 3, 4)]
    frame = spark.createDataFrame(rows, "release_day date, day date, coastal_segment_id int, drift_index double")
    got = {r.day: r.drift_index for r in sea.drift_recent(frame).collect()}
    assert got[day] == 1001.0


def test_sea_state_ignores_hours_without_waves(spark):
    rows = [("2024-01-01 00:00", None, 270.0, 9.0, None), ("2024-01-01 01:00", 2.0, 270.0, 5.0, None)]
    frame = spark.createDataFrame(
        rows, "t string, wave_height_m double, wave_direction_deg double, wave_period_s double, swell_height_m double"
    ).selectExpr("cast(t as timestamp_ntz) valid_at", "1D lat", "2D lon", "*")
    r = sea.daily_sea_state(frame).first()
    assert (r.wave_m, r.period_s, r.swell_m) == (2.0, 5.0, 0.0)
    assert r.east_m == pytest.approx(2.0) and r.north_m == pytest.approx(0.0, abs=1e-12)


def test_monthly_matrix_open_year(spark):
    frame = spark.createDataFrame(
        [("2022-03-01", 2), ("2022-12-31", 1), ("2024-05-05", 3), ("2024-01-01", None)], "t string, individual_count int"
    ).selectExpr("cast(t as timestamp_ntz) recorded_at", "individual_count")
    got = {r.year: tuple(r)[1:] for r in serving.monthly_matrix(frame).collect()}
    assert set(got) == {2022, 2024}
    assert got[2022] == (0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 1)
    assert got[2024] == (0, 0, 0, 0, 3) + (None,) * 7


def test_window_sums_equal_adding_up_the_neighbours(spark):
    rng = random.Random(9)
    own = {}
    for _ in range(300):
        key = (rng.randrange(3), rng.randrange(2020, 2023), rng.choice([0, 3, 14, 15, 16, 59, 200, 350, 351, 365]))
        own[key] = own.get(key, 0) + 1
    counts = spark.createDataFrame([(*k, n) for k, n in own.items()], "segment_id int, year int, slot int, records long")
    want = {}
    for (segment, year, slot_), n in own.items():
        for o in range(-15, 16):
            key = (segment, year, (slot_ + o) % 366)
            want[key] = want.get(key, 0) + n
    got = history.circular_window_sum(counts)
    assert {(r.segment_id, r.year, r.slot): r.records for r in got.collect()} == want
    few = history.circular_window_sum(counts, spark.createDataFrame([(0,), (365,)], "slot int"))
    assert {(r.segment_id, r.year, r.slot): r.records for r in few.collect()} == {k: n for k, n in want.items() if k[2] in (0, 365)}
    # What is shuffled are the counts themselves: nothing is multiplied before.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


WILD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2e-308, 1e300, -1e300, 1.7976931348623157e308, 1 + 2**-52, 1 - 2**-53]


@pytest.mark.parametrize("shape", ["negative", "large", "repeated", "near", "wild", "infinite"])
def test_exact_quantiles_of_any_value(spark, shape):
    rng = np.random.default_rng(1)
    data = {
        "negative": rng.normal(size=3000) * 100,
        "large": np.r_[rng.random(500) * 1e300, -rng.random(700) * 1e12, rng.random(300) * 1e-300],
        "repeated": np.r_[np.full(900, -7.25), np.full(900, 3e9), rng.integers(-3, 3, 400)],
        "near": 1e15 + np.arange(2000) * 0.125,
        "wild": np.array(WILD * 3),
        "infinite": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf, np.nan]),
    }[shape]
    frame = spark.createDataFrame([(float(v),) for v in rng.permutation(data)] + [(None,)], "p double")
    wanted = (0.0, 0.1, 0.2, 0.5, 0.6, 0.999, 1.0)
    got = {r.q: r.value for r in ranking.exact_quantiles(frame, "p", wanted).collect()}
    ordered = np.sort(data)  # NaN last
    for q in wanted:
        at = q * (len(data) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        share = at - math.floor(at)
        want = low if low == high or share == 0 else low * (1 - share) + high * share
        assert got[q] == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)
    if shape in ("negative", "large", "repeated", "near"):
        exact = frame.selectExpr(f"percentile(p, array({', '.join(f'{q}D' for q in wanted)})) AS p").first().p
        assert [got[q] for q in wanted] == pytest.approx(exact, rel=1e-12)


def test_buckets_never_fall(spark):
    values = sorted({*WILD, *(float(v) for v in np.random.default_rng(2).normal(size=500) ** 9), *(2.0**k for k in range(-1074, 1024, 7)),
                     *(math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7))})
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r.b for r in frame.orderBy("v").select(ranking.coarse_bucket(F.col("v")).alias("b")).collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("kind", ["scores", "ties", "one score", "no hits"])
def test_misses_below_hits_equal_counting_pairs(spark, kind):
    rng = random.Random(4)
    score = {"scores": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([-2.0, 0.0, 1e-9, 0.5]), "one score": lambda: 0.25,
             "no hits": lambda: rng.random()}[kind]
    rows = [(score(), day, place, kind != "no hits" and rng.random() < 0.1) for day in range(12) for place in range(15)]
    frame = spark.createDataFrame(rows, "p double, day int, place int, hit boolean").unionByName(
        spark.createDataFrame([(None, 1, 1, True)], "p double, day int, place int, hit boolean"))
    got = ranking.misses_below_hits(frame, "p", F.col("hit"), ["day", "place"]).first()
    below = sum(1 for a in rows if a[3] for b in rows if not b[3] and b[:3] < a[:3])
    assert tuple(got) == (len(rows), sum(r[3] for r in rows), below)


@pytest.mark.parametrize("shape", ["spread", "ties", "one", "tiny"])
def test_exact_quantiles(spark, shape):
    rng = np.random.default_rng(0)
    data = {
        "spread": rng.random(5000),
        "ties": np.r_[np.full(3000, 0.25), rng.random(1000), [0.0, 1.0]],
        "one": np.array([0.7]),
        "tiny": rng.random(3000) * 1e-9,
    }[shape]
    frame = spark.createDataFrame([(float(v),) for v in data] + [(None,)], "p double")
    got = {r.q: r.value for r in ranking.exact_quantiles(frame, "p", (0.5, 0.999)).collect()}
    for q in (0.5, 0.999):
        assert got[q] == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_anchors_of_nothing_are_zero(spark):
    anchors = serving.index_anchors(spark.createDataFrame([], "probability double")).first()
    assert tuple(anchors) == (0.0, 0.0)


def test_ordinal_rank_splits_equal_scores(spark):
    rows = [(0.5 if i % 3 else i / 900, i) for i in range(900)]
    frame = spark.createDataFrame(rows, "score double, id int")
    got = {r.id: r.ordinal for r in ranking.ordinal_rank(frame, ["score", "id"]).collect()}
    assert [i for _, i in sorted(rows)] == sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(1, 901))


def test_occurrence_numbers_continue_over_chunks(spark):
    rows = [("a" if i % 4 else None, i // 10, i) for i in range(57)]
    frame = spark.createDataFrame(rows, "k string, run int, pos int")
    got = ranking.ordinal_in_group(frame, ["k"], ["run"], ["pos"], "n").orderBy("pos").collect()
    seen = {}
    for r in got:
        assert r.n == seen.get(r.k, 0)
        seen[r.k] = r.n + 1
    assert len(got) == 57


@pytest.mark.parametrize("keep", [0, 1, 17, 200, 500])
def test_smallest_by_hash_is_exact(spark, keep):
    frame = spark.range(200).withColumn("h", F.md5(F.col("id").cast("string")))
    want = {r.id for r in frame.orderBy("h").limit(keep).collect()}
    got = [r.id for r in ranking.smallest_by_hash(frame, F.col("h"), F.lit(keep)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def scored_rows(spark, seed=0, days=40, segments=12):
    rng = np.random.default_rng(seed)
    rows, hits = [], []
    for d in range(days):
        for s in range(segments):
            values = rng.gamma(1.0, 1.0, len(SIGNALS)) * (rng.random(len(SIGNALS)) > 0.2)
            seasonal = float(rng.uniform(0.01, 0.2))
            day = date(2024, 1, 1) + timedelta(days=d)
            rows.append((s, day, seasonal, float(rng.uniform(0, 0.3)), *map(float, values)))
            if rng.random() < 1 / (1 + math.exp(-(values[0] + values[3] - 3.0))):
                hits.append((s, day, 1))
    schema = "segment_id int, day date, seasonal double, probability double, " + ", ".join(f"{s} double" for s in SIGNALS)
    return rows, hits, spark.createDataFrame(rows, schema), spark.createDataFrame(hits, OBSERVED)


def irls(matrix, target):
    x = np.column_stack([np.ones(len(matrix)), matrix])
    penalty = 1e-3 * np.eye(x.shape[1])
    penalty[0, 0] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        w = np.clip(p * (1 - p), 1e-6, None)
        step = np.linalg.solve((x.T * w) @ x + penalty, (x.T * w) @ (x @ beta + (target - p) / w))
        if np.max(np.abs(step - beta)) < 1e-8:
            return step
        beta = step
    return beta


def test_fit_equals_a_dense_solver(spark):
    rows, hits, risk, observed = scored_rows(spark)
    model = evaluation.fit(risk, observed, baseline=-2.0, seed=3)
    struck = {(s, d) for s, d, _ in hits}
    data = np.array([r[4:] for r in rows])
    y = np.array([1.0 if (r[0], r[1]) in struck else 0.0 for r in rows])
    scales = [c[c > 0].mean() for c in data.T]
    for name, scale in zip(SIGNALS, scales, strict=True):
        assert model.scales[name] == pytest.approx(scale)
    # positives are over 1 in 21 here, so every negative is in the sample
    assert y.sum() * 20 >= (1 - y).sum()
    season = np.array([r[2] for r in rows])
    x = np.column_stack([np.log1p(data / scales), np.log(season / (1 - season)) + 2.0])
    beta = irls(x, y)
    assert model.intercept == pytest.approx(beta[0], abs=1e-6)
    assert [model.weights[s] for s in SIGNALS] == pytest.approx(list(beta[1:-1]), abs=1e-6)
    assert model.seasonal_weight == pytest.approx(beta[-1], abs=1e-6)
    assert RiskModel.from_json(model.to_json()) == model


def test_fit_refuses_empty_inputs(spark):
    _, _, risk, observed = scored_rows(spark, days=2)
    with pytest.raises(ValueError, match="0 segment-days are labelled"):
        evaluation.fit(risk.limit(0), observed, -2.0)
    with pytest.raises(ValueError, match="none of them struck"):
        evaluation.fit(risk, observed.limit(0), -2.0)


def test_sample_keeps_every_positive_and_the_exact_ratio(spark):
    _, hits, risk, observed = scored_rows(spark)
    few = observed.orderBy("day", "segment_id").limit(5)
    labelled = evaluation.label_struck(risk, few)
    chosen = evaluation.balanced_sample(labelled, ratio=20, seed=1).collect()
    assert sum(r.struck for r in chosen) == 5 and len(chosen) == 105


def test_skill_equals_the_rank_formula(spark):
    rows, hits, risk, observed = scored_rows(spark, seed=5)
    struck = {(s, d) for s, d, _ in hits}
    order = sorted(rows, key=lambda r: (r[3], r[1], r[0]))
    positive = [i + 1 for i, r in enumerate(order) if (r[0], r[1]) in struck]
    p, n = len(positive), len(rows) - len(positive)
    got = evaluation.skill(risk, observed).first()
    assert (got.rows, got.positives) == (len(rows), p)
    assert got.auc == pytest.approx((sum(positive) - p * (p + 1) / 2) / (p * n))
    none = evaluation.skill(risk, observed.limit(0)).first()
    assert (none.positives, none.auc) == (0.0, 0.0)
    empty = evaluation.skill(risk.limit(0), observed).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_the_sums_of_all_slots_are_never_sorted_or_grouped(spark):
    """The slots between two steps are made after the running sums, and years add up in the steps."""
    rng = random.Random(8)
    rows = [(s, y, slot, rng.randint(1, 4)) for s in range(3) for y in (1996, 1997) for slot in rng.sample(range(366), 20)]
    rows += [(9, 1996, 0, 2), (9, 1996, 365, 3), (9, 1996, 350, 1), (9, 1997, 15, 1)]
    counts = spark.createDataFrame(rows, "segment_id long, year int, slot int, records long")
    for keys, sums in ((2, history.circular_window_sum(counts)), (1, history.all_years_sum(counts))):
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert plan.index("explode") < plan.index("Sort ")
        expected = {}
        for s, y, slot, n in rows:
            for off in range(-15, 16):
                key = (s, y)[:keys] + ((slot + off) % 366,)
                expected[key] = expected.get(key, 0) + n
        assert {tuple(r)[:-1]: r.records for r in sums.collect()} == expected


def test_drift_is_dealt_to_tasks_of_bounded_rows(spark, small, monkeypatch):
    from tidewrack.catalog import inputs

    monkeypatch.setattr(inputs, "DRIFT_ROWS", 100, raising=False)
    daily = inputs.drift_daily(spark, small)
    assert daily.rdd.getNumPartitions() >= inputs.table(spark, small, "lineitem").count() / 100
    # The sums of a segment are made where its rows are.
    plan = sea.drift_recent(daily)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_risk_keeps_of_the_history_what_a_span_needs(spark):
    rows = observed_rows()
    observed = spark.createDataFrame(rows, OBSERVED)
    first, last = date(2021, 1, 5), date(2021, 1, 9)
    start, end = F.lit(first), F.lit(last)
    few = history.gathered(observed, start, end)
    assert few.count() < len(rows) / 4
    assert few.groupBy("segment_id").agg(F.count_if(F.col("day") <= date(2021, 1, 1)).alias("n")).agg(F.max("n")).first()[0] == 1
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    spine = spark.createDataFrame([(s, d) for s in range(5) for d in days], "segment_id int, day date")
    value = lambda of: {(r.segment_id, r.day): r.persistence for r in history.persistence(of, spine).collect()}
    whole, short = value(observed), value(few)
    assert whole.keys() == short.keys()
    for key, expected in whole.items():
        assert (expected or 0.0) == pytest.approx(short[key] or 0.0, rel=1e-12)

    # The windows of days around the turn of the year reach into both ends of it.
    slots = slots_between(spark.createDataFrame([(d,) for d in days], "day date"))
    near = history.in_windows_of(observed, slots)
    assert near.count() < len(rows) / 4
    sums = lambda of: {tuple(r) for r in history.circular_window_sum(
        history.climatology_counts(of), slots).select("segment_id", "year", "slot", "records").collect()}
    assert sums(near) == sums(observed)
