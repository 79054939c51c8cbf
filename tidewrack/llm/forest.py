"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled, shuffled
from tidewrack.llm.components import component_labels

#: Splits in a row that one pass over the rows makes; a leaf's code grows by so many bits a pass.
DEPTH = 6
#: Passes at most: DEPTH * PASSES bits, besides 6 for the tree and the size of the vector.
PASSES = 6
BOTTOM = 1 << DEPTH
#: A split whose larger side keeps more than this share of the rows does not help.
LARGEST_SIDE = 0.65
SALTS = 16


# -- vectors ----------------------------------------------------------------------------------------


def matrix(v: pa.Array, size: int) -> np.ndarray:
    """Vectors of one size as unit rows in double precision."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _marked(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, key, v) per row: a 128-bit digest of the components, null where the vector takes no part."""
    kind = embeddings.schema[vector_column].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            keys = []
            for one in v:
                values = one.values
                key = None
                if values is not None and len(values) and not values.null_count:
                    c = values.to_numpy().astype(float)
                    if np.isfinite(c).all() and c.any():
                        key = hashlib.blake2b((c + 0.0).tobytes(), digest_size=16).digest()
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), v], names=["vec_id", "key", "v"]
            )

    rows = embeddings.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("v")
    )
    return settled(rows.mapInArrow(run, f"vec_id long, key binary, v array<{kind}>"))


def salted_join(rows: DataFrame, unique: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join of `rows` with a table of one row per `key`; a key that many rows share is spread by
    the column `spread` over SALTS partitions."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(shuffled(copies), [key, "_salt"], "left").drop("_salt")


# -- trees ------------------------------------------------------------------------------------------


def directions(seed: int, turn: int, tree: int, size: int) -> np.ndarray:
    """Unit directions of the DEPTH splits that a pass makes in one tree."""
    r = np.random.default_rng([seed, turn, tree, size]).normal(size=(size, DEPTH))
    return r / np.linalg.norm(r, axis=0)


def margin(threshold: float, spill: float, size: int) -> float:
    """Half the width of the overlap: `spill` standard deviations of the projected difference of two
    vectors that are just alike."""
    return spill / 2 * float(np.sqrt((2 - 2 * threshold) / size))


def grow(projected: np.ndarray, total: int, leaf_rows: int, tau: float) -> np.ndarray:
    """Thresholds in heap order, medians of a sample that stands for `total` rows; infinite (all rows go
    left) where none helps."""
    thresholds = np.full(BOTTOM - 1, np.inf)
    stack = [(0, np.arange(len(projected)))]
    while stack:
        at, own = stack.pop()
        if at >= len(thresholds) or len(own) < 8 or len(own) * total <= leaf_rows * len(projected):
            continue
        p = projected[own, (at + 1).bit_length() - 1]
        cut = np.median(p)
        left, right = own[p < cut + tau], own[p >= cut - tau]
        if max(len(left), len(right)) <= LARGEST_SIDE * len(own):
            thresholds[at] = cut
            stack += [(2 * at + 1, left), (2 * at + 2, right)]
    return thresholds


def descend(projected: np.ndarray, thresholds: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bottom leaf) of every leaf a row falls into; a row near a threshold goes both ways."""
    rows, at = np.arange(len(projected)), np.zeros(len(projected), dtype=np.int64)
    for level in range(DEPTH):
        cut, p, near = thresholds[rows, at], projected[rows, level], tau[rows]
        left, right = p < cut + near, p >= cut - near
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    return rows, at - (BOTTOM - 1)


def _leaves(
    points: DataFrame, trees: int, leaf_rows: int, sample_rows: int, threshold: float, spill: float, seed: int
) -> DataFrame:
    """(node, leaf) of every leaf that a point (node, v) is in; the least codes belong to the first tree."""

    def projected(v: pa.Array, leaf: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        root = leaf >> DEPTH * turn
        out, tau = np.empty((len(leaf), DEPTH)), np.empty(len(leaf))
        for one in np.unique(root):
            own = np.flatnonzero(root == one)
            tree, size = divmod(int(one), 1 << 20)
            out[own] = matrix(v.take(pa.array(own)), size) @ directions(seed, turn, tree, size)
            tau[own] = margin(threshold, spill, size)
        return out, tau

    def steps(turn: int):
        """What grows the splits of a leaf from its sample, and what sends rows down them."""

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            p, tau = projected(pa.array(frame["v"].tolist()), frame["leaf"].to_numpy(), turn)
            cuts = grow(p, int(frame["n"].iloc[0]), leaf_rows, tau[0])
            return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "above": frame["n"].iloc[:1], "cuts": [cuts]})

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                p, tau = projected(batch.column("v"), leaf, turn)
                row, bottom = descend(p, batch.column("cuts").flatten().to_numpy().reshape(len(leaf), -1), tau)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(take), batch.column("v").take(take),
                        pa.array((leaf[row] << DEPTH) + bottom), batch.column("above").take(take),
                    ],
                    names=["node", "v", "leaf", "above"],
                )

        return build, route

    of_tree = lambda t: F.shiftleft(t.cast("long"), 20) + F.size("v")
    roots = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), of_tree))
    rows = points.select("node", "v", roots.alias("leaf"), F.lit(None).cast("long").alias("above"))
    shape = f"node long, v {points.schema['v'].dataType.simpleString()}, leaf long, above long"
    done = []
    for turn in range(PASSES + 1):
        last = turn == PASSES
        counts = settled(rows.groupBy("leaf").agg(F.count("*").alias("n"), F.max("above").alias("above")))
        helped = F.col("above").isNull() | (F.col("n") <= LARGEST_SIDE * F.col("above"))
        open_leaves = counts.where((F.col("n") > leaf_rows) & helped & ~F.lit(last)).select("leaf", "n")
        few = broadcast_if_small(settled(open_leaves), 32)
        to_end = F.shiftleft("leaf", DEPTH * (PASSES - turn)).alias("leaf")
        done.append(settled(rows.join(few, "leaf", "left_anti").select("node", to_end)))
        if few.isEmpty():
            break

        build, route = steps(turn)
        drawn = F.pmod(F.xxhash64("node", "leaf"), F.col("n")) < sample_rows
        cuts = settled(
            rows.join(few, "leaf").where(drawn).groupBy("leaf")
            .applyInPandas(build, "leaf long, above long, cuts array<double>")
        )
        split = rows.drop("above").join(broadcast_if_small(cuts, 9 * BOTTOM), "leaf")
        rows = settled(split.mapInArrow(route, shape))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed


# -- inside a leaf -----------------------------------------------------------------------------------


def met_before(earlier: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j also share a leaf of a smaller code; `earlier` lists those, padded with -1."""
    width = earlier.shape[1]
    out = np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 24) // max(1, width * width))
    for at in range(0, len(i) if width else 0, step):
        a, b = earlier[i[at : at + step]], earlier[j[at : at + step]]
        out[at : at + step] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))
    return out


def compare(
    x: np.ndarray, copies: np.ndarray, earlier: np.ndarray, block: np.ndarray, within: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) per row of a leaf, or of two blocks of one.

    links counts the copies of the rows with a cosine from `threshold` on that it did not meet in an
    earlier leaf; label is the least position among the rows it is connected with. Pairs live only
    while a strip of rows is compared.
    """
    n = len(x)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, n, 256):
        near = x[lo : lo + 256] @ x[lo:].T >= threshold
        near &= np.arange(lo, n)[None, :] > np.arange(lo, min(lo + 256, n))[:, None]
        if not within:
            near &= block[lo : lo + 256, None] != block[None, lo:]
        i, j = np.nonzero(near)
        i, j = i + lo, j + lo
        while True:  # the least label spreads over the links of this strip
            least = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
            label = label[label]
            if (before == label).all():
                break
        new = ~met_before(earlier, i, j)
        i, j = i[new], j[new]
        links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
    while (label[label] != label).any():
        label = label[label]
    return links, label


def _found(placed: DataFrame, points: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(node, links, root): per point and leaf it has a link in, new links and a connected point."""
    sizes = settled(placed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    many = settled(sizes.where("blocks > 1"))
    own = placed.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = (
        points.join(shuffled(own), "node")
        .withColumn("leaf", F.explode("leaves"))
        .withColumn("earlier", F.filter("leaves", lambda x: x < F.col("leaf")))
        .join(broadcast_if_small(many, 32), "leaf", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("block", "other"))
        .withColumn("b", F.greatest("block", "other"))
        .select("leaf", "a", "b", "block", "node", "v", "copies", "earlier")
    )

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size = len(frame["v"].iloc[0])
        x = matrix(pa.array(frame["v"].tolist()), size)
        earlier = frame["earlier"].tolist()
        padded = np.full((len(frame), max(map(len, earlier))), -1, np.int64)
        for row, codes in zip(padded, earlier, strict=True):
            row[: len(codes)] = codes
        links, label = compare(
            x, frame["copies"].to_numpy(), padded, frame["block"].to_numpy(), key[1] == key[2], threshold
        )
        node = frame["node"].to_numpy()
        out = pd.DataFrame({"node": node, "links": links, "root": node[label]})
        return out[(links > 0) | (label != np.arange(len(label)))]

    return settled(rows.groupBy("leaf", "a", "b").applyInPandas(run, "node long, links long, root long"))


# -- the operator ------------------------------------------------------------------------------------


def near_vectors(
    embeddings: DataFrame,
    threshold: float = 0.95,
    trees: int = 4,
    spill: float = 1.0,
    leaf_rows: int = 1024,
    block_rows: int = 2048,
    sample_rows: int = 4096,
    seed: int = 11,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: vectors whose cosine is at least `threshold` link.

    Equal vectors are one point with a number of copies. Every tree splits the points at medians of
    random projections, taken from at most about `sample_rows` points of a node, down to some
    `leaf_rows`; points within `spill` / 2 standard deviations (of what two linked vectors differ by)
    of a threshold go both ways. All points of a leaf are compared, in doubles, and every link is
    verified; a pair that shares several leaves counts in the first. Leaves that no split makes
    smaller (a large group of near copies) are compared whole, block against block. What leaves a
    task is one row per point and leaf, never its pairs. Links that no tree has in a leaf are missed.

    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable,
    kept says that a row has that id. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different sizes. Rows that repeat a
    vec_id each count; a null id is in no component_id and not kept. An empty table gives no rows.
    Other columns are not used.
    """
    marked = _marked(embeddings, id_column, vector_column)
    points = settled(
        marked.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    placed = _leaves(points.select("node", "v"), trees, leaf_rows, sample_rows, threshold, spill, seed)
    found = _found(placed, points.select("node", "v", "copies"), threshold, block_rows)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = component_labels(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Points without links are labelled by themselves; their least id is their own.
    own = points.select("node", "key", "copies", "least").join(shuffled(links), "node", "left")
    own = settled(own.join(shuffled(labels), "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    known = settled(
        salted_join(own, least, "label", "node").select(
            "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    )
    alone = F.col("key").isNull()
    return (
        salted_join(marked.select("vec_id", "key"), known, "key", "vec_id")
        .withColumn("component_id", F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")))
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            "component_id",
            F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )
