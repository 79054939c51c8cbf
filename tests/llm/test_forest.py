"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from tidewrack.llm import common, components, forest

SCHEMA = "vec_id long, embedding array<float>, node string, key int"
ODD = [
    (9001, None), (9002, []), (9003, [0.0] * 6), (9004, [float("nan")] + [0.1] * 5),
    (9005, [float("inf")] + [0.1] * 5), (9006, [None] + [0.1] * 5), (9007, [1.0, 0.0]), (9008, [2.0, 0.0]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "n", 0) for i, v in rows], SCHEMA)


def plain(rows, threshold=0.95):
    """Bag of (vec_id, n_links, component_id, kept) by comparing all pairs."""
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in usable}
    near = {k: [] for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in usable}:
        own = [k for k in usable if len(rows[k][1]) == size]
        m = np.stack([unit[k] for k in own])
        for a, b in np.argwhere(m @ m.T >= threshold):
            if a != b:
                near[own[a]].append(own[b])
    out, label = [], {}
    for k in range(len(rows)):
        if k not in label:
            group, stack = {k}, [k]
            while stack:
                for other in near[stack.pop()]:
                    if other not in group:
                        group.add(other)
                        stack.append(other)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            label.update(dict.fromkeys(group, min(ids, default=None)))
        out.append((rows[k][0], len(near[k]), label[k], rows[k][0] is not None and rows[k][0] == label[k]))
    return out


def got(df):
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def scattered(rng, n, size):
    """Clusters, chains of near copies, one very common vector and one large group of near copies."""
    x = rng.normal(size=(n, size))
    x[: n // 5] = x[0] + rng.normal(size=(n // 5, size)) * 0.12  # near copies
    x[n // 5 : n // 2] = x[n // 5]  # a third are one vector
    for k in range(n // 2, n - 40, 7):  # chains
        x[k + 1] = x[k] + rng.normal(size=size) * 0.2
        x[k + 2] = x[k + 1] + rng.normal(size=size) * 0.2
    return x.astype(np.float32)


@pytest.mark.parametrize("leaf_rows, block_rows", [(1024, 2048), (40, 64)])
def test_rows_equal_all_pairs(spark, leaf_rows, block_rows):
    rng = np.random.default_rng(7)
    x = scattered(rng, 900, 6)
    rows = [*zip([*range(898), 3, None], x.tolist(), strict=True), *ODD]
    done = forest.near_vectors(frame(spark, rows).repartition(5), trees=12, spill=2.0, leaf_rows=leaf_rows, block_rows=block_rows)
    assert in_order(got(done)) == in_order(plain(rows))


def test_recall_over_several_passes(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6000, 16))
    near = base[:1500] + rng.normal(size=(1500, 16)) * 0.25
    x = np.vstack([base, near])
    rows = list(enumerate(x.tolist()))
    want, mine = plain(rows), {r[0]: r for r in got(forest.near_vectors(frame(spark, rows), leaf_rows=16, sample_rows=300))}
    links = sum(r[1] for r in want)
    assert links > 1500
    assert all(mine[r[0]][1] <= r[1] for r in want)  # none below the threshold, none twice
    assert sum(r[1] for r in mine.values()) >= 0.95 * links


def test_tiny_and_empty_tables(spark):
    assert got(forest.near_vectors(frame(spark, []))) == []
    assert in_order(got(forest.near_vectors(frame(spark, ODD)))) == in_order(plain(ODD))
    two = [(5, [1e-30, 0.0]), (2, [1e30, 1e29])]
    assert in_order(got(forest.near_vectors(frame(spark, two)))) == [(2, 1, 2, True), (5, 1, 2, False)]


def test_a_pair_that_shares_leaves_counts_once():
    x = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    copies, block = np.array([1, 5, 2]), np.zeros(3, int)
    none = np.full((3, 1), -1)
    links, label = forest.compare(x, copies, none, block, True, 0.95)
    assert links.tolist() == [5, 1, 0] and label.tolist() == [0, 0, 2]
    links, label = forest.compare(x, copies, np.array([[7], [7], [7]]), block, True, 0.95)
    assert links.tolist() == [0, 0, 0] and label.tolist() == [0, 0, 2]
    links, _ = forest.compare(x, copies, none, np.array([0, 1, 0]), False, -1.0)
    assert links.tolist() == [5, 3, 5]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written."""
    seen = []
    for module in (forest, components):
        monkeypatch.setattr(module, "settled", lambda df: (seen.append(plan(df)), common.settled(df))[1])
    return seen


def test_tables_that_grow_are_broadcast_only_if_counted_small(spark, plans, monkeypatch):
    """Spark takes the 16 copies of a row that a salted join makes for one, and files for what they hold."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)  # no count is small enough
    rows = [*enumerate(scattered(np.random.default_rng(9), 300, 6).tolist()), *ODD]
    done = forest.near_vectors(frame(spark, rows), trees=12, spill=2.0, leaf_rows=40, block_rows=64)
    assert in_order(got(done)) == in_order(plain(rows))
    assert len(plans) > 10 and not [p for p in (*plans, plan(done)) if "Broadcast" in p]


def test_a_job_broadcasts_the_leaves_of_one_turn(spark, plans):
    base = np.random.default_rng(10).normal(size=(3000, 16))
    found = forest.near_vectors(frame(spark, list(enumerate(base.tolist()))), trees=1, leaf_rows=8, sample_rows=300)
    assert found.count() == 3000
    assert sum("cuts" in p for p in plans) > 2  # it took several turns
    assert max(p.count("BroadcastExchange") for p in plans if "leaf" in p) == 1
