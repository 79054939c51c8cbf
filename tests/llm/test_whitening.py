"""Exact covariances and whitening against plain computations."""

from fractions import Fraction

import numpy as np
import pytest

from tidewrack.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string"
ODD = [
    (901, None, "a"), (902, [], "b"), (903, [float("nan"), 1.0, 1.0], "c"), (904, [float("-inf"), 1.0, 1.0], "d"),
    (905, [None, 1.0, 1.0], "e"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], t) for i, v, t in rows], SCHEMA)


def plain(vectors):
    """Integers, exact covariance (as fractions) and deviations of some vectors of one size."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(size)]
    d = [[n * r[i] - s[i] for i in range(size)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(size)] for i in range(size)]
    return d, cov


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e11])
def test_polarised_sums_give_the_exact_covariance(spread):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 6)) * spread).astype(np.int64)
    n, sums = len(x), x.astype(object).sum(0)
    d = whitening.deviations(x, n, sums)
    total = whitening.polarised(d)
    whole = d.astype(object)
    for i in range(6):
        assert total[i, i] == (whole[:, i] ** 2).sum()
        for j in range(i + 1, 6):
            assert total[i, j] == ((whole[:, i] + whole[:, j]) ** 2).sum()
    assert whitening.covariance(total, n) == pytest.approx(np.cov(x.T.astype(float), ddof=0), rel=1e-9)


def test_whitened_rows_equal_a_plain_computation(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    v[100:330] = v[5]  # a third of the rows are one vector
    ids = [*range(698), 3, None]  # a repeated id and a row without one
    rows = [(i, w, "t") for i, w in zip(ids, v, strict=True)]
    got = whitening.whitened(frame(spark, [*rows, *ODD]), most=8).toPandas()
    assert len(got) == 700 * 8
    d, cov = plain(v)
    assert (got["n"] == 700).all()
    deviation = sorted(sum(c * c for c in r) for r in d for _ in range(8))
    assert sorted(got["deviation"]) == deviation
    v_matrix = np.array([[float(c) for c in r] for r in cov])
    e, u = np.linalg.eigh(v_matrix)
    e, u = e[::-1], u[:, ::-1]
    own = got[got["vec_id"] == 17].sort_values("component")
    wanted = (np.array(d[17], dtype=float) / 700) @ u / np.sqrt(e)
    assert np.abs(own["whitened"]).to_numpy() == pytest.approx(np.abs(wanted[:8]), rel=1e-9)
    assert own["explained"].to_numpy() == pytest.approx((e / np.trace(v_matrix))[:8], rel=1e-9)
    table = got.pivot_table(index="deviation", columns="component", values="whitened", aggfunc="count")
    assert (table.to_numpy().std(axis=1) == 0).all()
    values = np.stack([got[got["component"] == c]["whitened"].to_numpy() for c in range(1, 9)])
    assert np.cov(values, ddof=0).diagonal() == pytest.approx(np.ones(8), abs=1e-9)
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 4)).astype(np.float32)
    got = whitening.whitened(frame(spark, [(i, w, "") for i, w in enumerate(v)]).repartition(7), most=4).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.cov(w.T, ddof=0) == pytest.approx(np.eye(4), abs=1e-9)


def test_sizes_apart_nothing_varying_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0], ""), (2, [3.0, 1.0], ""), (3, [5.0], ""), (4, [5.0], ""), (5, [2.0, 9.0, 9.0], "")]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame(spark, rows)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), (5, 2), (5, 3)}
    assert abs(got[1, 1].whitened) == pytest.approx(1.0) and got[1, 1].whitened == pytest.approx(-got[2, 1].whitened)
    assert got[1, 2].whitened is None  # two rows vary in one direction only
    assert got[1, 1].explained == pytest.approx(1.0)
    assert got[3, 1].whitened is None and got[3, 1].explained is None and got[3, 1].deviation == 0 and got[3, 1].n == 2
    assert got[5, 1].n == 1
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, ODD)).count() == 0
