"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, ceil_div, deal, settled, vectors


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds of the index.

    sample_rows bounds the rows the centroids are fitted on, max_lists the centroids (both are
    driver and broadcast memory); every row is indexed. A row joins up to `replicas` lists whose
    distance is within `boundary` times its nearest. A query visits all lists within `probe_ratio`
    times its nearest, and further ones until they hold enough rows. The graph search finds the
    `beam` nearest; where they do not reach the ratio, the query is compared with all centroids.
    Without a given `probe_ratio` it is the smallest one, of a few, that gives a sample of some
    `judged_queries` queries the `recall` against all rows.
    """

    list_rows: int = 512
    max_lists: int = 16_384
    sample_rows: int = 65_536
    replicas: int = 2
    boundary: float = 1.1
    index_beam: int = 12
    beam: int = 128
    probe_ratio: float | None = None
    recall: float = 0.98
    judged_queries: int = 256
    degree: int = 16
    task_rows: int = 16_384
    task_queries: int = 4_096
    seed: int = 11


def balanced_centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of `lists` parts of equal size: two-means directions, each cut at its median."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        rows = parts.pop()
        if len(rows) < 2:
            parts.append(rows)
            break
        points = sample[rows]
        a, b = points[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            near_a = points @ (a - b) > (a + b) @ (a - b) / 2
            if near_a.all() or not near_a.any():
                break
            a, b = points[near_a].mean(0), points[~near_a].mean(0)
        order = np.argsort(points @ (a - b), kind="stable")
        parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return np.unique(np.array([sample[rows].mean(0) for rows in parts]), axis=0)


def graph_links(centroids: np.ndarray, degree: int, seed: int) -> np.ndarray:
    """Of each centroid: its nearest ones, two along a ring through all, and a few far ones."""
    norms, n = (centroids * centroids).sum(1), len(centroids)
    near = min(degree, n)
    links = np.empty((n, near), dtype=np.int64)
    for lo in range(0, n, 1024):
        d = norms[None] - 2 * centroids[lo : lo + 1024] @ centroids.T
        links[lo : lo + 1024] = np.argpartition(d, near - 1, axis=1)[:, :near]
    ring = (np.arange(n)[:, None] + np.array([1, -1])) % n
    far = np.random.default_rng(seed).integers(0, n, (n, max(2, degree // 4)))
    return np.hstack([links, ring, far])


class CentroidGraph:
    """Linked centroids, searched by beams."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray) -> None:
        self.centroids, self.links = centroids, links
        self.norms = (centroids * centroids).sum(1)
        n = len(centroids)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def distances(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of point i to centroids nodes[i]."""
        picked = self.centroids[nodes]
        d = (points * points).sum(1)[:, None] + self.norms[nodes] - 2 * np.einsum("ij,ikj->ik", points, picked)
        return np.maximum(d, 0)

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids found for each point, nearest first, and their distances."""
        n, rows = len(self.centroids), np.arange(len(points))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(points), n), dtype=bool)
        nodes = np.tile(self.entries, (len(points), 1))
        seen[:, self.entries] = True
        d = self.distances(points, nodes)
        done = np.zeros(nodes.shape, dtype=bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            nodes, d, done = nodes[rows, order], d[rows, order], done[rows, order]
            todo = np.where(done | np.isinf(d), np.inf, d)
            width = min(4, nodes.shape[1])
            pick = np.argsort(todo, axis=1, kind="stable")[:, :width]
            live = np.isfinite(todo[rows, pick])
            if not live.any():
                return nodes, np.sqrt(d)
            done[rows, pick] = True
            fresh = self.links[nodes[rows, pick]].reshape(len(points), -1)
            known = seen[rows, fresh] | ~np.repeat(live, self.links.shape[1], axis=1)
            seen[rows, fresh] |= ~known
            first = np.argsort(fresh, axis=1, kind="stable")
            repeated = np.zeros(fresh.shape, dtype=bool)
            ordered = fresh[rows, first]
            repeated[rows, first[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
            # The first unseen occurrence of a node stands for all of them.
            new = np.where(known | repeated, np.inf, self.distances(points, fresh))
            nodes, d = np.hstack([nodes, fresh]), np.hstack([d, new])
            done = np.hstack([done, np.isinf(new)])


def lists_of(graph: CentroidGraph, points: np.ndarray, beam: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: up to `most` lists of each point within `ratio` times its nearest."""
    rows, lists = [], []
    for lo in range(0, len(points), 512):
        nodes, d = graph.search(points[lo : lo + 512], beam)
        keep = (d <= ratio * d[:, :1] + 1e-12) & np.isfinite(d)
        keep[:, most:] = False
        r, c = np.nonzero(keep)
        rows.append(r + lo)
        lists.append(nodes[r, c])
    return np.concatenate(rows), np.concatenate(lists)


def lists_within(
    graph: CentroidGraph, points: np.ndarray, beam: int, ratio: float, held: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: all lists of each point within `ratio` times its nearest, and further ones,
    nearest first, until they hold `least` rows (list i holds held[i]) or no list is left."""
    rows, lists = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]

    def keep(at: np.ndarray, nodes: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Adds what the points `at` visit of these nodes; False where further nodes could be visited."""
        has = np.where(np.isfinite(d), held[nodes], 0)
        near = ((d <= ratio * d[:, :1] + 1e-12) | (np.cumsum(has, axis=1) - has < least)) & np.isfinite(d)
        whole = ~near[:, -1] if nodes.shape[1] < len(held) else np.ones(len(at), dtype=bool)
        r, c = np.nonzero(near & whole[:, None])
        rows.append(at[r])
        lists.append(nodes[r, c])
        return whole

    for lo in range(0, len(points), 512):
        some = points[lo : lo + 512]
        nodes, d = graph.search(some, beam)
        # An infinite distance is a node not reached: the search stopped short of the beam.
        reached = np.isfinite(d).all(axis=1)
        at = np.arange(len(some))
        open_at = at[~reached]
        done = keep(lo + at[reached], nodes[reached], d[reached])
        open_at = np.concatenate([open_at, at[reached][~done]])
        if len(open_at):
            far = some[open_at]
            every = (far * far).sum(1)[:, None] + graph.norms - 2 * far @ graph.centroids.T
            every = np.sqrt(np.maximum(every, 0))
            order = np.argsort(every, axis=1, kind="stable")
            keep(lo + open_at, order, np.take_along_axis(every, order, axis=1))
    return np.concatenate(rows), np.concatenate(lists)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last in doubles."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_in_list(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a list segment for each of its queries, ties to smaller ids."""
    found = []
    size = max(1, 2_000_000 // max(1, len(x)))
    for lo in range(0, len(q), size):
        rough = q[lo : lo + size] @ x.T
        rough[query_ids[lo : lo + size, None] == ids[None]] = -np.inf
        kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        slack = 1e-12 * np.sqrt((q[lo : lo + size] ** 2).sum(1)) * np.sqrt((x * x).sum(1).max())
        i, j = np.nonzero((rough >= (kth - slack)[:, None]) & np.isfinite(rough))
        score = np.concatenate([products(q[lo + i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k
        found.append(pd.DataFrame({"query_id": query_ids[lo + i[kept]], "vec_id": ids[j[kept]], "score": score[kept]}))
    return pd.concat(found)


def measured_ratio(
    clean: DataFrame, postings: DataFrame, graph: CentroidGraph, held: np.ndarray, k: int, query_every: int, s: Settings
) -> float:
    """The distance ratio that gives a bounded sample of queries the wanted recall against all rows.

    The sample's true neighbours are searched in one pass over all rows. A neighbour is found from
    the ratio on at which one of its lists is visited; ratios are tried upwards by the lists the
    search really visits, the last one visits all.
    """
    asked = clean.where(F.col("vec_id") % query_every == 0)
    rows = asked.orderBy(F.xxhash64("vec_id", F.lit(s.seed + 1)), "vec_id").limit(s.judged_queries).collect()
    if not rows:
        return 1.0
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    sent = clean.sparkSession.sparkContext.broadcast((ids, v))  # at most judged_queries rows

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v = sent.value
        held_best = None
        for batch in batches:
            if len(batch):
                best = best_in_list(ids, v, batch["vec_id"].to_numpy(), np.stack(batch["v"].to_numpy()), k)
                best = pd.concat([held_best, best]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                held_best = best[best.groupby("query_id").cumcount() < k]
        if held_best is not None:
            yield held_best

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (
        clean.mapInPandas(compare, "query_id long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    # At most k neighbours of each judged query, each in up to `replicas` lists.
    pairs = postings.join(F.broadcast(settled(true)), "vec_id").select("query_id", "vec_id", "list").toPandas()
    if not len(pairs):
        return 1.0
    points = np.hstack([v, np.zeros((len(v), 1))])
    at = pairs["query_id"].map({q: i for i, q in enumerate(ids.tolist())}).to_numpy()
    every = np.sqrt(np.maximum((points * points).sum(1)[:, None] + graph.norms - 2 * points @ graph.centroids.T, 0))
    lists = pairs["list"].to_numpy()
    needed = every[at, lists] / np.maximum(every.min(axis=1)[at], 1e-300)
    needed = pairs.assign(needed=needed).groupby(["query_id", "vec_id"])["needed"].min().to_numpy()
    for part in np.linspace(s.recall, 1.0, 5):
        ratio = float(np.quantile(needed, part, method="higher")) * (1 + 1e-9)
        row, visited = lists_within(graph, points, s.beam, ratio, held, s.replicas * (k + 1))
        seen = np.zeros(every.shape, dtype=bool)
        seen[row, visited] = True
        if pairs.assign(found=seen[at, lists]).groupby(["query_id", "vec_id"])["found"].any().mean() >= s.recall:
            return ratio
    return float("inf")


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    query_every: int = 20,
    settings: Settings = Settings(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found of largest inner product per query.

    Rows get one more component that makes all of them equally long, so that nearest by distance
    is largest by product. Centroids are fitted on a bounded sample of distinct vectors; every row
    is indexed under its nearest list and, near a boundary, under a further one. A task searches a
    bundle of lists; larger ones are dealt into segments and the queries into blocks of bounded
    size, so a list that holds a third of all rows is searched by many tasks. A query gives k rows
    per bundle; how many lists it visits has no bound but their number; the
    ratio that ends its search is measured on each run, see `measured_ratio`. The rows of a bundle
    are sent once per block of the queries that visit it. Scores are products of the original vectors.

    Null, zero and empty vectors, vectors with a null or non-finite component and rows without an
    id take no part. Vectors of different sizes are searched apart. An id that occurs repeatedly
    counts once. Ties go to the smaller id. An empty table gives no rows.
    """
    usable = vectors(embeddings, id_column, vector_column).where(F.exists("v", lambda x: x != 0))
    clean = settled(usable)
    found = None
    for r in clean.select(F.size("v").alias("n")).distinct().orderBy("n").collect():
        own = _nearest_of_one_size(clean.where(F.size("v") == r["n"]), k, query_every, settings)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _nearest_of_one_size(clean: DataFrame, k: int, query_every: int, s: Settings) -> DataFrame:
    """`nearest` for rows (vec_id, v) of one size."""
    spark = clean.sparkSession
    length2 = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    total, longest2 = clean.agg(F.count("*"), F.coalesce(F.max(length2), F.lit(0.0))).first()
    result = "query_id long, vec_id long, score double"
    share = F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(1_000_000))
    taken = clean.where(share < F.lit(1_000_000 * min(1.0, s.sample_rows / total))).select("v")
    fitted = np.array([r["v"] for r in taken.toLocalIterator()] or [clean.first()["v"]])

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, longest2 - (v * v).sum(1)))[:, None]])

    sample = np.unique(lifted(fitted), axis=0)
    lists = min(s.max_lists, ceil_div(total, s.list_rows), len(sample))
    centroids = balanced_centroids(sample, lists, s.seed)
    links = graph_links(centroids, s.degree, s.seed)
    sent = spark.sparkContext.broadcast((centroids, links))  # at most max_lists of each

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = CentroidGraph(*sent.value)
        for batch in batches:
            if len(batch):
                v = lifted(np.stack(batch["v"].to_numpy()))
                rows, found = lists_of(graph, v, s.index_beam, s.boundary, s.replicas)
                yield batch.iloc[rows].assign(list=found.astype("int32"))

    postings = settled(clean.mapInPandas(indexed, "vec_id long, v array<double>, list int"))
    # One number per list, so at most max_lists: neighbouring lists are bundled up to task_rows.
    held = np.zeros(len(centroids), dtype=np.int64)
    for r in postings.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    # A row is in up to `replicas` lists, and a query does not count itself.
    least, ratio = s.replicas * (k + 1), s.probe_ratio
    if ratio is None:
        ratio = measured_ratio(clean, postings, CentroidGraph(centroids, links), held, k, query_every, s)
    bundle_of = (np.cumsum(held) - held) // s.task_rows
    rows_of = np.bincount(bundle_of, weights=held)
    segments_of = np.maximum(1, np.ceil(rows_of / s.task_rows)).astype(int)
    bundles = F.broadcast(
        spark.createDataFrame(
            [(i, int(b), int(segments_of[b])) for i, b in enumerate(bundle_of)], "list int, bundle int, segments int"
        )
    )

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = CentroidGraph(*sent.value)
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                rows, found = lists_within(graph, np.hstack([v, np.zeros((len(v), 1))]), s.beam, ratio, held, least)
                visits = pd.DataFrame({"row": rows, "list": found, "bundle": bundle_of[found]})
                lists = visits.groupby(["row", "bundle"])["list"].agg(list).reset_index()
                out = batch.iloc[lists["row"]].reset_index(drop=True)
                out["bundle"], out["lists"] = lists["bundle"].astype("int32"), lists["list"]
                out["segments"] = segments_of[lists["bundle"]].astype("int32")
                yield out

    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visits = settled(
        clean.where(F.col("vec_id") % query_every == 0)
        .repartition("vec_id")
        .mapInPandas(visiting, "vec_id long, v array<double>, bundle int, lists array<int>, segments int")
    )
    # As many blocks of queries as visit a bundle: rows of others are not sent for them.
    blocks = settled(visits.groupBy("bundle").agg(F.ceil(F.count("*") / s.task_queries).cast("int").alias("blocks")))
    blocks = broadcast_if_small(blocks, 16)
    queries = visits.join(blocks, "bundle").select(
        "bundle", upto(F.col("segments")).alias("segment"), deal(F.col("vec_id"), F.col("blocks")).alias("block"), "vec_id", "v", "lists"
    )
    rows = postings.join(bundles, "list").join(blocks, "bundle").select(
        "bundle", deal(F.col("vec_id"), F.col("segments")).alias("segment"), upto(F.col("blocks")).alias("block"),
        "vec_id", "v", "list",
    )

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(q) and len(x):
            points, ids, asked = np.stack(x["v"].to_numpy()), x["vec_id"].to_numpy(), np.stack(q["v"].to_numpy())
            wanted = np.concatenate(q["lists"].to_numpy())
            asking = np.repeat(np.arange(len(q)), q["lists"].map(len))
            for one, at in x.groupby("list").indices.items():
                who = asking[wanted == one]
                if len(who):
                    found.append(best_in_list(q["vec_id"].to_numpy()[who], asked[who], ids[at], points[at], k))
        best = pd.concat(found).drop_duplicates(["query_id", "vec_id"])
        best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return best[best.groupby("query_id").cumcount() < k]

    key = ("bundle", "segment", "block")
    found = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
