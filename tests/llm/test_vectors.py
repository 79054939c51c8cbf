"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from tidewrack.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, ids=None, extra=()):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


ODD = [
    (900_001, None, 1), (900_002, [], 1), (900_003, [0.0] * 8, 1), (900_004, [float("nan")] + [0.1] * 7, 1),
    (900_005, [float("inf")] + [0.1] * 7, 1), (900_006, [None] + [0.1] * 7, 1), (None, [0.9] * 8, 1),
]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[200:330] = x[3]  # a third of the rows are one vector
    got = topk.top_products(frame(spark, x, extra=ODD), query_every=10, block_rows=90, block_queries=16).collect()
    v = np.floor(256 * x.astype(float)).astype(int)
    # the zero vector takes part here; only it does of the odd ones
    ids = [*range(400), 900_003]
    v = np.vstack([v, np.zeros(8, int)])
    want = []
    for q, i in enumerate(ids):
        if i % 10 == 0:
            ranked = sorted((-int(v[q] @ v[c]), j) for c, j in enumerate(ids) if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_topk_of_few_rows_large_components_and_several_sizes(spark):
    rows = [(0, [3.0e7, -1.0], 0), (1, [2.0e7, 5.0], 0), (10, [1.0], 0), (20, [2.0, 2.0, 2.0], 0), (21, [1.0, 0.0, 0.5], 0)]
    got = topk.top_products(spark.createDataFrame(rows, SCHEMA), query_every=10).collect()
    big = (256 * 30_000_000) * (256 * 20_000_000) + (-256) * (256 * 5)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 1, min(big, 2**63 - 1)), (20, 21, 512 * 256 + 512 * 128)]
    assert topk.top_products(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(50, 30)), rng.normal(size=(7, 30))
    for n in (1, 4, 7, 30):
        assert (topk._segments(q, n) @ topk._segments(x, n).T >= q @ x.T - 1e-9).all()


def recall(spark, x, settings):
    got = ann.nearest(frame(spark, x, extra=ODD), settings=settings).collect()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    queries = range(0, len(x), 20)
    for q in queries:
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        for _, v, score in rows:
            assert score == pytest.approx(s[q, v], abs=1e-12)
        assert [(r[2], -r[1]) for r in rows] == sorted(((r[2], -r[1]) for r in rows), reverse=True)
        hits += len({r[1] for r in rows} & set(np.lexsort((np.arange(len(x)), -s[q]))[:20].tolist()))
    return hits / (20 * len(queries))


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 8))
    x = (centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8)) * 0.5).astype(np.float32)
    assert recall(spark, x, ann.Settings(list_rows=100, task_rows=500, task_queries=40)) >= 0.9


def test_neighbours_with_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[500:1000] = x[7]
    assert recall(spark, x, ann.Settings(list_rows=100, task_rows=300, task_queries=40)) >= 0.9


def test_neighbours_of_tiny_and_empty_tables(spark):
    few = frame(spark, [[1.0, 0.0], [0.5, 0.5], [2.0, 1.0]], ids=[0, 20, 3])
    got = ann.nearest(few).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 3, 2.0), (0, 2, 20, 0.5), (20, 1, 3, 1.5), (20, 2, 0, 0.5),
    ]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_equals_exhaustive_on_small_graphs():
    rng = np.random.default_rng(8)
    c = rng.normal(size=(200, 6))
    graph = ann.CentroidGraph(c, ann.graph_links(c, 16, 1))
    points = rng.normal(size=(50, 6))
    nodes, d = graph.search(points, 32)
    true = np.argsort(((points[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :5]
    hits = sum(len(set(a[:5]) & set(b)) for a, b in zip(nodes.tolist(), true.tolist(), strict=True))
    assert hits >= 240
    assert (np.diff(d, axis=1) >= 0).all()


def test_visited_lists_grow_with_their_number(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(-1, 1, size=(6000, 24)).astype(np.float32)
    s = ann.Settings(list_rows=10, beam=64, probe_ratio=1.35)
    assert recall(spark, x, s) >= 0.95
    x[1] *= 1000  # all lifted distances become alike
    assert recall(spark, x, s) >= 0.95


def test_short_lists_still_give_k_rows(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    recall(spark, x, ann.Settings(list_rows=2, beam=4, probe_ratio=1.0))


def test_the_ratio_follows_the_vectors(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    assert recall(spark, x, ann.Settings(list_rows=16, boundary=1.0)) >= 0.95


def test_vectors_of_each_size_are_searched_apart(spark):
    rng = np.random.default_rng(15)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 3 else 5)], 0) for i in range(240)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), k=4, settings=ann.Settings(list_rows=20, task_rows=60, task_queries=4)).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for i, v, _ in rows[::20]:
        ranked = sorted((-float(np.float32(v).astype(float) @ np.float32(w).astype(float)), j) for j, w, _ in rows if j != i and len(w) == len(v))
        hits += len({j for _, j in ranked[:4]} & {j for _, j in found[i]})
    assert set(found) == {i for i, _, _ in rows[::20]} and hits >= 0.9 * 4 * 12
