"""Ranked lexical search: buckets of documents by the length of their impact vectors, pruned exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, ceil_div, deal, settled

#: Bytes of UTF-8 that belong to a term, A-Z as a-z; all others separate terms.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
STRIP = 1 << 22
IMPACTS = "doc_id long, length double, terms array<int>, impacts array<int>"
FOUND = "item long, doc_id long, score long"


# -- terms ------------------------------------------------------------------------------------------


def term_strips(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text in order, a few MB of it at a time."""
    raw, at = text.translate(TERM_BYTES), 0
    while at < len(raw):
        end = len(raw)
        if end - at > STRIP:
            end = raw.rfind(b" ", at, at + STRIP)
            end = end if end > at else raw.find(b" ", at + STRIP)
            end = end if end > 0 else len(raw)
        yield raw[at:end].split()
        at = end


def term_counts(text: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and the occurrences of each known one by its number."""
    total, held = 0, Counter()
    for terms in term_strips(text):
        total += len(terms)
        held.update(map(known.get, terms))
    held.pop(None, None)
    return total, held


def _counted(docs: DataFrame, known, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term; `known` is a broadcast table of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(known.value)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                kept, sizes, ends, terms, tfs = [], [], [0], [], []
                for row, text in enumerate(some.column("text")):
                    n, counts = term_counts(text.as_py() or b"", numbers)
                    if n:
                        kept.append(row)
                        sizes.append(n)
                        terms += counts.keys()
                        tfs += counts.values()
                        ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of `size` terms occurs; a task gives each of its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _impacts(counted: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """(doc_id, length, terms, impacts) of the documents with a known term; length is the Euclidean one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            sizes, tf = terms.value_lengths().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            m = 50 + (50 * batch.column("n").to_numpy() * documents) // all_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            squares = np.concatenate([[0.0], np.cumsum(impact.astype(float) ** 2)])
            length = np.sqrt(squares[ends[1:]] - squares[ends[:-1]])
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(impact.astype(np.int32)))
            own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms.flatten())
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length), own, flat], names=["doc_id", "length", "terms", "impacts"]
            )
            yield out.filter(pa.array(sizes > 0))

    return counted.mapInArrow(run, IMPACTS)


# -- one bucket -------------------------------------------------------------------------------------


class Bucket:
    """Impact vectors of some documents of similar length, by term."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        self.ids, self.length, self.longest = ids, length, float(length.max(initial=0.0))
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), sizes)[order]
        self.impacts = impacts[order].astype(np.int64)
        held = terms[order]
        starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(held))
        largest = np.maximum.reduceat(self.impacts, starts) if len(starts) else starts
        #: Of each term: where its documents are, and its largest impact.
        self.of = dict(zip(held[starts].tolist(), zip(starts.tolist(), ends.tolist(), largest.tolist(), strict=True), strict=True))

    def best(self, terms: list[int], weights: list[int], norm: float, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, doc_id) of all documents of this bucket that may be among the k best from `floor` on.

        `floor` is a score that k documents are known to reach, or 1. By Cauchy-Schwarz no score
        exceeds norm * longest. A coordinate is at most the largest impact of its term here: the
        terms that together stay below the floor can add to a document, but not bring one in.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if norm * self.longest * (1 + 1e-9) < floor:
            return none
        reach = sorted((w * self.of[t][2], t, w) for t, w in zip(terms, weights, strict=True) if t in self.of and w > 0)
        if sum(r[0] for r in reach) < floor:
            return none
        rest, beside = 0, 0
        while beside < len(reach) and rest + reach[beside][0] < floor:
            rest += reach[beside][0]
            beside += 1
        score, squares = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for _, t, w in reach[beside:]:
            a, b, _ = self.of[t]
            rows, impacts = self.rows[a:b], self.impacts[a:b]
            score[rows] += w * impacts
            squares[rows] += impacts.astype(float) ** 2
        left = np.flatnonzero(score)
        if beside:
            # What the other terms add is bounded by their coordinates, and by the length that is left.
            other = math.sqrt(sum(float(w) ** 2 for _, _, w in reach[:beside]))
            spare = np.sqrt(np.maximum(self.length[left] ** 2 * (1 + 1e-9) - squares[left], 0.0)) + 1.0
            left = left[score[left] + np.minimum(rest, other * spare * (1 + 1e-9)) >= floor]
        found = score[left]
        for _, t, w in reach[:beside]:
            a, b, _ = self.of[t]
            rows = self.rows[a:b]
            at = np.minimum(np.searchsorted(rows, left), b - a - 1)
            found += np.where(rows[at] == left, w * self.impacts[a:b][at], 0)
        good = found >= floor
        found, ids = found[good], self.ids[left[good]]
        if len(found) > k:
            order = np.lexsort((ids, -found))[:k]
            found, ids = found[order], ids[order]
        return found, ids


# -- the search -------------------------------------------------------------------------------------


def _search(vectors: DataFrame, queries, k: int, bucket_rows: int) -> DataFrame:
    """(item, doc_id, score): the k best of each partition per query, from the query's floor on.

    `queries` is a broadcast list of (item, terms, weights, norm, floor).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        floors = [q[4] for q in asked]
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, bucket_rows):
                some = batch.slice(at, bucket_rows)
                terms = some.column("terms")
                bucket = Bucket(
                    some.column("doc_id").to_numpy(), some.column("length").to_numpy(), terms.value_lengths().to_numpy(),
                    terms.flatten().to_numpy(), some.column("impacts").flatten().to_numpy(),
                )
                for i, (_, own, weights, norm, _) in enumerate(asked):
                    score, ids = bucket.best(own, weights, norm, floors[i], k)
                    if len(score):
                        score, ids = np.concatenate([kept[i][0], score]), np.concatenate([kept[i][1], ids])
                        order = np.lexsort((ids, -score))[:k]
                        kept[i] = score[order], ids[order]
                        if len(order) == k:
                            floors[i] = max(floors[i], int(score[order[-1]]))
        for (item, *_), (score, ids) in zip(asked, kept, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), item)), pa.array(ids), pa.array(score)], names=["item", "doc_id", "score"]
                )

    return vectors.mapInArrow(run, FOUND)


def _ranked_block(
    docs: DataFrame, items: list[tuple[int, bytes]], k: int, bucket_rows: int, strata: tuple[float, ...],
    id_column: str, text_column: str,
) -> DataFrame | None:
    """(item, doc_id, score, rank) for a block of items; None if no document has a term."""
    context = docs.sparkSession.sparkContext
    texts = {item: sorted({t for strip in term_strips(text) for t in strip}) for item, text in items}
    vocabulary = sorted({t for own in texts.values() for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = settled(_counted(docs, context.broadcast(vocabulary), id_column, text_column))
    documents, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
    if not documents or not vocabulary:
        return None
    df = _document_frequencies(counted, len(vocabulary))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()]
    named = counted.where("doc_id IS NOT NULL")
    vectors = settled(_impacts(named, documents, all_terms).sortWithinPartitions(F.desc("length")))
    cuts = vectors.agg(F.percentile_approx("length", [1 - s for s in strata], 1000)).first()[0] or [0.0] * len(strata)
    above = [math.inf, *cuts]
    asked = []
    for item, terms in texts.items():
        own = [number[t] for t in terms]
        norm = math.sqrt(sum(weight[t] ** 2 for t in own))
        asked.append([item, own, [weight[t] for t in own], norm, 1])
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = None
    for step, upper in enumerate(above):
        stratum = vectors.where(F.col("length") < upper) if step else vectors
        if step < len(cuts):
            stratum = stratum.where(F.col("length") >= cuts[step])
        found = _search(stratum, context.broadcast(asked), k, bucket_rows)
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = settled(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        # One number per item of the block: the score that k documents reach by now.
        reached = {r["item"]: r["score"] for r in top.where(F.col("rank") == k).select("item", "score").collect()}
        for query in asked:
            query[4] = max(query[4], reached.get(query[0], 1))
    return top


def ranked(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 50,
    bucket_rows: int = 4096,
    strata: tuple[float, ...] = (1 / 32, 1 / 4),
    block_bytes: int = 4 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score per benchmark item, above 0.

    A term's weight comes from the documents that hold it, a document's impact of a term from its
    occurrences and the length of the document; the score adds weight * impact over an item's
    distinct terms, all in integers. Documents are searched in the order of the Euclidean length of
    their impact vectors: first the longest 1/32, then the rest of the longest quarter, then the
    others, in buckets of `bucket_rows`. The score that k documents reached by then rules out
    buckets by Cauchy-Schwarz and documents by the largest coordinates of the bucket and by the
    length that is left; what survives is scored exactly. Nothing is shuffled but k rows per item
    and partition. Items are taken in blocks of about `block_bytes` of text, each a pass over all
    documents, so what is broadcast is bounded.

    Null texts have no terms; a document without terms counts nowhere. Documents without an id
    count in the statistics but are not ranked; rows that repeat an id are ranked each. Equal scores
    go by the smaller id. Equal rows of the benchmark count once; rows that share an id but not the
    text are ranked each. Items without terms, or whose terms no document has, give no rows, nor do
    empty tables. Other columns are not used.
    """
    texts = benchmark.select(
        F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).cast("binary").alias("text")
    )
    items = settled(texts.where("text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = ceil_div(size, block_bytes)
    result = None
    for b in range(blocks):
        own = [(r["item"], bytes(r["text"])) for r in items.where(deal(F.col("item"), blocks) == b).collect()]
        part = _ranked_block(docs, own, k, bucket_rows, strata, id_column, text_column)
        if part is not None:
            result = part if result is None else result.unionByName(part)
    if result is None:
        result = docs.sparkSession.createDataFrame([], FOUND + ", rank int")
    names = broadcast_if_small(items.select("item", "item_id"), 32)
    return result.join(names, "item").select("item_id", "rank", "doc_id", "score")
