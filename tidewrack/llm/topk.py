"""Exact top-k by inner product, pruned with segment means and deviations, coarse to fine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import ceil_div, deal, settled, vectors

RESULT = "query_id long, vec_id long, score long"


def _segments(x: np.ndarray, count: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of each of `count` segments of each row."""
    edges = np.linspace(0, x.shape[1], count + 1).astype(int)
    length = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    spread = np.add.reduceat((x - np.repeat(mean, np.diff(edges), axis=1)) ** 2, edges[:-1], axis=1)
    return np.hstack([mean * np.sqrt(length), np.sqrt(spread)])


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact there, else in Python integers."""
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if reach < 2.0**53:
        return (x @ q).astype(np.int64)
    exact = np.array([[int(c) for c in row] for row in x], dtype=object) @ np.array([int(c) for c in q], dtype=object)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], dtype=np.int64)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, levels: tuple[int, ...]
) -> pd.DataFrame:
    """The k best rows of a block for each query (ties to smaller ids), of one common dimension.

    |q - x|^2 is at least the sum over segments of length * ((difference of means)^2 + (difference
    of deviations)^2), so <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 is at most the inner product of
    the segment statistics. A level's bound is computed only for what the coarser level left.
    """
    levels = tuple(dict.fromkeys(min(n, rows.shape[1]) for n in levels))
    stats = [_segments(rows, n) for n in levels]
    asked = [_segments(queries, n) for n in levels]
    slack = 1e-9 * np.sqrt((rows * rows).sum(1).max(initial=0.0))
    found = []
    for i, q in enumerate(queries):
        allowed = slack * np.sqrt(q @ q) + 1e-9
        left = np.flatnonzero(ids != query_ids[i])
        if not len(left):
            continue
        floor = -np.inf
        for level, own in zip(stats, asked, strict=True):
            bound = level[left] @ own[i] if len(left) < len(rows) - 1 else (level @ own[i])[left]
            if len(left) > k:
                likely = left[np.argpartition(bound, -k)[-k:]]
                floor = max(floor, float(_exact(rows[likely], q).min()))
                left = left[bound >= floor - allowed]
        score = _exact(rows[left], q)
        best = np.lexsort((ids[left], -score.astype(object) if score.min() == -(2**63) else -score))[:k]
        found.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[left][best], "score": score[best]}))
    return pd.concat(found) if found else pd.DataFrame({c: np.array([], dtype="int64") for c in ("query_id", "vec_id", "score")})


def top_products(
    embeddings: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    levels: tuple[int, ...] = (4, 16),
    block_rows: int = 32_768,
    block_queries: int = 4_096,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product per query.

    Components are floor(scale * x). Queries are the rows whose id is divisible by `query_every`;
    candidates are all rows of the same dimension but the query's own. Both sides are dealt by hash
    into blocks of a bounded number of rows; each pair of blocks is one group, which keeps its k
    best per query, so a query gathers k rows per block of candidates.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
    without an id; an id that occurs repeatedly counts once. Ties go to the smaller id. Fewer than k
    candidates give fewer rows; an empty table gives none. Scores beyond a long are clipped to it.
    """
    clean = settled(vectors(embeddings, id_column, vector_column))
    is_query = F.col("vec_id") % query_every == 0
    total, asked = clean.agg(F.count("*"), F.count_if(is_query)).first()
    row_parts, query_parts = ceil_div(total, block_rows), ceil_div(asked, block_queries)
    rows = clean.withColumn("b", deal(F.col("vec_id"), row_parts)).withColumn(
        "a", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))
    )
    queries = (
        clean.where(is_query)
        .withColumn("a", deal(F.col("vec_id"), query_parts))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))
    )

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        q_size, x_size = q["v"].map(len).to_numpy(), x["v"].map(len).to_numpy()
        for size in np.unique(q_size):
            own, other = q[q_size == size], x[x_size == size]
            if len(other):
                found.append(
                    search_block(
                        own["vec_id"].to_numpy(), np.floor(scale * np.stack(own["v"].to_numpy())),
                        other["vec_id"].to_numpy(), np.floor(scale * np.stack(other["v"].to_numpy())), k, levels,
                    )
                )
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = queries.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
