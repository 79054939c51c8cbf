"""SimHash near-duplicates: fingerprints linked through BK-trees, then grouped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, deal, settled, whole_groups
from tidewrack.llm.components import component_labels

PIECE = 1 << 16


# -- fingerprints -----------------------------------------------------------------------------------


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits as a signed long: each bit set in over half of the hashes of the word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], 42) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) per row. Null, empty and blank texts have the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())],
                names=["doc_id", "text_hash", "fp"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# -- BK-trees ---------------------------------------------------------------------------------------


class BkForest:
    """One BK-tree per group, of distinct codes; the first code of a group is its root.

    Children hang under their parent by integer Hamming distance. All trees grow level by level at
    once: of the codes that reach a node at the same distance, the first becomes its child there and
    the others go on below that child.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        """`group` is sorted."""
        self.codes = codes
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
        self.root_of_group = dict(zip(group[first].tolist(), np.flatnonzero(first).tolist(), strict=True))
        at = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
        below = np.flatnonzero(~first)
        edges, children = [], []
        while len(below):
            edge = at[below] * 128 + np.bitwise_count(codes[below] ^ codes[at[below]])
            order = np.argsort(edge, kind="stable")
            below, edge = below[order], edge[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            edges.append(edge[new])
            children.append(below[new])
            at[below] = below[np.maximum.accumulate(np.where(new, np.arange(len(below)), 0))]
            below = below[~new]
        edge = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        child = np.concatenate(children) if children else np.zeros(0, dtype=np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]  # edge: parent * 128 + distance

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) positions at most `radius` apart; only edges within the radius are followed."""
        who, node = np.arange(len(queries)), roots
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            d = np.bitwise_count(queries[who] ^ self.codes[node]).astype(np.int64)
            near = d <= radius
            hits.append((who[near], node[near]))
            low = np.searchsorted(self.edge, node * 128 + np.maximum(d - radius, 1))
            high = np.searchsorted(self.edge, node * 128 + np.minimum(d + radius, 64), side="right")
            n = np.maximum(high - low, 0)
            who = np.repeat(who, n)
            node = self.child[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (who, node)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions the smallest label among them, in place."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels[:] = labels[labels]


def shard_links(frame: pd.DataFrame, radius: int, cells: int = 2_000_000) -> pd.DataFrame:
    """(a, b) edges that join the linked codes of each shard: a star per component of the shard.

    Rows: key, t, u (a shard), share, code; sorted by key, t, u. The tree holds the rows of share t;
    those of share u ask.
    """
    shard = (frame[["key", "t", "u"]] != frame[["key", "t", "u"]].shift()).any(axis=1).cumsum().to_numpy() - 1
    sizes = np.bincount(shard)
    keep = sizes[shard] > 1
    frame, shard = frame[keep], shard[keep]
    codes = frame["code"].to_numpy().astype(np.uint64)
    tree = np.flatnonzero((frame["share"] == frame["t"]).to_numpy())
    asks = np.flatnonzero((frame["share"] == frame["u"]).to_numpy())
    forest = BkForest(codes[tree], shard[tree])
    size_of = dict(zip(*(x.tolist() for x in np.unique(shard[tree], return_counts=True)), strict=True))
    asks = asks[[g in size_of for g in shard[asks].tolist()]] if len(asks) else asks
    roots = np.array([forest.root_of_group[g] for g in shard[asks].tolist()], dtype=np.int64)
    work = np.cumsum([size_of[g] for g in shard[asks].tolist()]) if len(asks) else np.zeros(0)
    labels = np.arange(len(codes))
    for block in range(int(work[-1] // cells) + 1 if len(work) else 0):
        lo, hi = np.searchsorted(work, [block * cells, (block + 1) * cells])
        who, node = forest.within(codes[asks[lo:hi]], roots[lo:hi], radius)
        _merge(labels, asks[lo:hi][who], tree[node])
    linked = labels != np.arange(len(codes))
    signed = codes.astype(np.int64)
    return pd.DataFrame({"a": signed[linked], "b": signed[labels[linked]]})


def _block_keys(code: Column, radius: int, blocks: int) -> Column:
    """The values of every choice of `blocks - radius` blocks: codes within the radius share one."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [
        F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])
    ]
    chosen = list(combinations(range(blocks), blocks - radius))
    return F.array(*(F.xxhash64(F.lit(i), *(parts[b] for b in pick)) for i, pick in enumerate(chosen)))


def links(codes: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 4_096) -> DataFrame:
    """(a, b): edges that connect all distinct codes (column `code`) within the Hamming radius.

    Codes at most `radius` bits apart agree in at least `blocks - radius` of the blocks, so they
    meet under one of their keys. The codes under a key are dealt into shards of some `shard_rows`
    codes; a BK-tree is built per shard and sent, by shuffle, to each block of codes of the same key
    that asks it. Keys with more codes get more shards, not larger tasks. A shard gives a spanning
    star of each group it links instead of all pairs.
    """
    spread = codes.select(F.explode(_block_keys(F.col("code"), radius, blocks)).alias("key"), "code")
    hot = settled(
        spread.groupBy("key").count().where(F.col("count") > shard_rows)
        .select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards"))
    )
    share = F.col("share")
    dealt = (
        spread.join(broadcast_if_small(hot, 16), "key", "left")
        .withColumn("shards", F.coalesce("shards", F.lit(1)))
        .withColumn("share", deal(F.col("code"), F.col("shards")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("key", F.least(share, "other").alias("t"), F.greatest(share, "other").alias("u"), "share", "code")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["key", "t", "u"]):
            yield shard_links(frame, radius)

    return (
        dealt.repartition("key", "t", "u")
        .sortWithinPartitions("key", "t", "u", "code")
        .mapInPandas(run, "a long, b long")
        .distinct()
    )


# -- the operator -----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id) per row of `docs`.

    component_id is the smallest doc_id of all documents reachable through links of at most `radius`
    differing bits. Copies share a fingerprint and are grouped before any search, so a group of
    copies is one code. Null, empty and blank texts have the fingerprint zero and link like others.
    Rows without a doc_id get the component of what they link to, null if nothing there has an id.
    Rows that repeat a doc_id stay rows of their own. Other columns of `docs` are not used.
    """
    rows = settled(fingerprints(docs, width))
    codes = settled(rows.groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("first")))
    labels = component_labels(settled(links(codes, radius, blocks)))
    linked = codes.join(labels, codes.code == labels.node)
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    # Only linked codes meet by label: most codes have none, and would all meet under null.
    named = labels.join(smallest, "label").select("node", "component_id")
    found = settled(
        codes.join(named, codes.code == named.node, "left").select(
            F.col("code").alias("fp"), F.coalesce("component_id", "first").alias("component_id")
        )
    )
    return rows.join(found, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, radius: int = 3, width: int = 3, blocks: int = 5) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Among rows with that doc_id, or rows without any, the smallest hash of the text counts; of equal
    rows one stays.
    """
    near = near_duplicates(docs, radius, width, blocks)
    # A component without ids is told by its fingerprint.
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    kept = settled(
        near.groupBy("component_id", alone.alias("alone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
        .select(F.col("k.doc_id").alias("__kept_id"), F.col("k.text_hash").alias("__kept_hash"))
    )
    here = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__hash") == F.col("__kept_hash"))
    return (
        here.join(broadcast_if_small(kept, 24), same, "left_semi")
        .dropDuplicates(["doc_id", "__hash"])
        .drop("__hash")
    )


# -- documents alike by their shingles --------------------------------------------------------------


@dataclass(frozen=True)
class Alike:
    """Documents are alike from a Jaccard similarity of `least` of their shingles of `width` words.

    Texts meet under a key of `per_key` least shingle hashes; of the `keys` keys two texts of
    similarity 0.8 share one with probability 1 - (1 - 0.8^3)^6 = 0.987. Codes of such texts differ
    in 9.7 of 64 bits on average, so the radius leaves out few; what it links is verified.
    """

    width: int = 5
    least: float = 0.8
    radius: int = 18
    keys: int = 6
    per_key: int = 3
    shard_rows: int = 512


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles; of a shorter text the hash of all its words."""
    words = (text or b"").lower().split()
    width = min(width, len(words))
    spans = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in spans), np.uint64, len(spans)))


def meeting_keys(shingles: np.ndarray, a: Alike) -> np.ndarray:
    """One key per group of `per_key` least hashes; a text without words has one of its own."""
    factors = np.random.default_rng(42).integers(0, 2**63, (2, a.keys * a.per_key), dtype=np.uint64)
    if not len(shingles):
        return np.zeros(1, dtype=np.int64)
    least = np.array([(shingles * (f | np.uint64(1)) + g).min() for f, g in factors.T], dtype="<u8").reshape(a.keys, -1)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(least)], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def alike_in_shard(codes: np.ndarray, sets: list[np.ndarray], a: Alike) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that connect all alike rows of a shard.

    All rows are compared with the first one. Two rows alike to it are connected already; a row that
    is not is compared with all rows its code is near to.
    """
    first = np.array([jaccard(sets[0], x) >= a.least for x in sets])
    left, right = [np.flatnonzero(first)], [np.zeros(first.sum(), dtype=int)]
    asks = np.flatnonzero(~first)
    if len(asks):
        distinct, code_of, times = np.unique(codes, return_inverse=True, return_counts=True)
        rows_of = np.split(np.argsort(code_of, kind="stable"), np.cumsum(times)[:-1])
        forest = BkForest(distinct, np.zeros(len(distinct), dtype=int))
        who, code = forest.within(codes[asks], np.zeros(len(asks), dtype=int), a.radius)
        who, node = np.repeat(asks[who], times[code]), np.concatenate([rows_of[c] for c in code.tolist()])
        other = (who != node) & (first[node] | (who < node))
        labels = np.arange(len(codes))
        for x, y in zip(who[other].tolist(), node[other].tolist(), strict=True):
            if labels[x] != labels[y] and jaccard(sets[x], sets[y]) >= a.least:
                labels[labels == labels[y]] = labels[x]
                left.append(np.array([x]))
                right.append(np.array([y]))
    return np.concatenate(left), np.concatenate(right)


def alike_links(rows: DataFrame, a: Alike) -> DataFrame:
    """(a, b): verified edges between bodies. rows: body, fp, keys, shingles; settled."""
    spread = rows.select("body", F.explode("keys").alias("key")).distinct()
    sizes = settled(spread.groupBy("key").count().where("count > 1"))
    shards = sizes.select("key", F.ceil(F.col("count") / a.shard_rows).cast("int").alias("shards"))
    met = settled(spread.join(broadcast_if_small(shards, 16), "key"))
    wanted = settled(met.select("body").distinct())
    texts = rows.join(broadcast_if_small(wanted, 16), "body", "left_semi").select("body", "fp", "shingles").dropDuplicates(["body"])
    share = deal(F.col("body"), F.col("shards"))
    dealt = (
        met.withColumn("share", share)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("key", F.least("share", "other").alias("t"), F.greatest("share", "other").alias("u"), "body")
        .join(texts, "body")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["key", "t", "u"], 2 * a.shard_rows):
            for _, shard in frame.groupby(["key", "t", "u"], sort=False):
                if len(shard) > 1:
                    sets = [np.frombuffer(x, "<u8") for x in shard["shingles"]]
                    left, right = alike_in_shard(shard["fp"].to_numpy().astype(np.uint64), sets, a)
                    body = shard["body"].to_numpy()
                    yield pd.DataFrame({"a": body[left], "b": body[right]})

    return (
        dealt.repartition("key", "t", "u")
        .sortWithinPartitions("key", "t", "u", "body")
        .mapInPandas(run, "a long, b long")
        .distinct()
    )


def first_alike(docs: DataFrame, a: Alike = Alike()) -> DataFrame:
    """One document of each group connected by verified pairs: the one with the smallest doc_id.

    Texts of the same words, but for case and white space, are one body; texts without words too.
    Rows without a doc_id come last; of those and of rows with the same doc_id the smallest hash of
    the text stays, of equal rows one. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t.as_py() for t in part.column("text")]
                sets = [shingle_set(t, a.width) for t in texts]
                body = [xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split()), 7) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_hash"), pa.array(np.array(body, np.uint64).view(np.int64)),
                        pa.array([fingerprint(t, a.width) for t in texts], pa.int64()),
                        pa.array([meeting_keys(x, a) for x in sets], pa.list_(pa.int64())),
                        pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "body", "fp", "keys", "shingles"],
                )

    texts = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")
    )
    rows = settled(
        texts.mapInArrow(run, "doc_id long, text_hash long, body long, fp long, keys array<long>, shingles binary")
    )
    labels = component_labels(settled(alike_links(rows, a)))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    bodies = settled(rows.groupBy("body").agg(row.alias("k")))
    kept = settled(
        bodies.join(labels, bodies.body == labels.node, "left")
        .groupBy(F.coalesce("label", "body").alias("of"))
        .agg(F.min("k").alias("k"))
        .select(F.col("k.doc_id").alias("__kept_id"), F.col("k.text_hash").alias("__kept_hash"))
    )
    here = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (F.col("__hash") == F.col("__kept_hash"))
    return here.join(broadcast_if_small(kept, 24), same, "left_semi").dropDuplicates(["doc_id", "__hash"]).drop("__hash")
