"""Connected components of a graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect each larger neighbour of a node with the smallest node around it; of `n` edges come `n`."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = broadcast_if_small(least, 64, 2 * n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect a node and its smaller neighbours with the smallest of them; `edges` has `n` rows."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(broadcast_if_small(least, 64, n), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, of every node that an edge (a, b) names.

    Alternates large-star and small-star until nothing changes; each round ends in a written table,
    and rounds grow with the logarithm of the longest path. Edges never leave the executors, unless counted small.
    """
    edges = settled(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    mark, n = None, edges.count()
    while True:
        edges = settled(_small_star(_large_star(edges, n), n).where("u <> v").distinct())
        # Stars only: every node points at its root, and no root points anywhere.
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return settled(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots))
