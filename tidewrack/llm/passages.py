"""Substring dedup: recurring phrases located by Aho-Corasick automata, then whole windows compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, ceil_div, deal, settled

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(hashes) - k + 1
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * _STEP + hashes[j : j + n]
    return _mixed(total)


def chosen_phrases(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window, where its phrase starts: the k words in it with the smallest hash.

    Equal windows have equal phrases at equal places, wherever they stand.
    """
    grams = gram_hashes(hashes, k)
    inside = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    return inside.argmin(axis=1) + np.arange(len(inside))


def split_words(text: bytes | None) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or b"").split()


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def _text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_copies(docs: DataFrame) -> DataFrame:
    """(text_key, first): the smallest document of each text that several rows have."""
    keyed = docs.where("text IS NOT NULL").select(_text_key(F.col("text")).alias("text_key"), _doc(F.col("doc_id")).alias("doc"))
    counted = keyed.groupBy("text_key").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    return settled(counted.where("n > 1").select("text_key", "first"))


def _marked(docs: DataFrame, copies: DataFrame, *columns: str) -> DataFrame:
    """(columns, doc, text, is_copy): whether a document with a smaller doc_id has the same text."""
    rows = docs.select(*columns, _doc(F.col("doc_id")).alias("doc"), F.col("text").cast("binary").alias("text"))
    known = rows.withColumn("text_key", _text_key(F.col("text"))).join(broadcast_if_small(copies, 90), "text_key", "left")
    return known.withColumn("is_copy", F.coalesce(F.col("first") < F.col("doc"), F.lit(False))).drop("text_key", "first")


def recurring_phrases(sliced: DataFrame, window: int, k: int) -> DataFrame:
    """(slice, phrase): the phrases of windows that at least two documents have, for each slice that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, share, phrase = [], [], []
            numbers = zip(batch.column("doc").to_pylist(), batch.column("slice").to_pylist(), strict=True)
            for (d, s), text in zip(numbers, batch.column("text"), strict=True):
                words = split_words(text.as_py())
                if len(words) >= window:
                    starts = np.unique(chosen_phrases(word_hashes(words), window, k)).tolist()
                    own = {b" ".join(words[i : i + k]) for i in starts}
                    phrase += own
                    doc += [d] * len(own)
                    share += [s] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(share, pa.int32()), pa.array(phrase, pa.binary())],
                names=["doc", "slice", "phrase"],
            )

    found = sliced.mapInArrow(run, "doc long, slice int, phrase binary")
    twice = found.groupBy("phrase").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.collect_set("slice").alias("slices")
    )
    return settled(twice.where("first < last").select(F.explode("slices").alias("slice"), "phrase"))


class PhraseAutomaton:
    """An Aho-Corasick automaton of phrases between spaces, over texts a character per byte."""

    def __init__(self, phrases: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases:
            self.automaton.add_word(f" {phrase.decode('latin-1')} ")
        self.automaton.make_automaton()

    def located(self, words: list[bytes]) -> np.ndarray:
        """Whether a phrase starts at each word."""
        text = f" {b' '.join(words).decode('latin-1')} "
        found = [end - length + 1 for end, length in self.automaton.iter(text)]
        starts = np.zeros(len(words), dtype=bool)
        if found:
            places = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts[np.searchsorted(places, found, side="right")] = True
        return starts


def recurring_windows(sliced: DataFrame, phrases: DataFrame, window: int, k: int) -> DataFrame:
    """(doc, h): the windows of each document, once each, whose phrase recurs.

    A slice of the documents is streamed through the automaton of the phrases that occur in it.
    """

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        doc, found = [], []
        if len(texts) and len(known):
            automaton = PhraseAutomaton(known["phrase"].tolist())
            for d, text in zip(texts["doc"].tolist(), texts["text"], strict=True):
                words = split_words(text)
                if len(words) < window:
                    continue
                starts = automaton.located(words)
                if starts.any():
                    hashes = word_hashes(words)
                    mine = starts[chosen_phrases(hashes, window, k)]
                    own = np.unique(gram_hashes(hashes, window)[mine])
                    found.append(own.view(np.int64))
                    doc.append(np.full(len(own), d))
        return pd.DataFrame({
            "doc": np.concatenate(doc) if doc else np.zeros(0, np.int64),
            "h": np.concatenate(found) if found else np.zeros(0, np.int64),
        })

    return sliced.groupBy("slice").cogroup(phrases.groupBy("slice")).applyInPandas(run, "doc long, h long")


def covered(words: list[bytes], repeated: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window with one of these hashes."""
    starts = np.isin(gram_hashes(word_hashes(words), window), repeated)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    depth[: len(starts)] += starts
    depth[window : window + len(starts)] -= starts
    return np.cumsum(depth[:-1]) > 0


def without_repeats(
    docs: DataFrame, window: int = 50, phrase_words: int = 8, slice_bytes: int = 16 << 20, with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row of `docs`.

    Each word goes that a window of `window` consecutive words covers whose words also stand, in that
    order, in a document with a smaller doc_id; windows are judged on the input. Every window has a
    phrase, chosen by its content alone, so a window that recurs has a phrase that recurs:

    0. documents whose whole text a smaller doc_id has too lose all their words (if they have a window
       at all) and add no window to it: only the first of a group of copies goes on;
    1. phrases that two documents share are confirmed word by word;
    2. documents are dealt into slices of about `slice_bytes`; the phrases that occur in a slice make
       its Aho-Corasick automaton, and its documents are streamed through it, each once;
    3. windows around the located phrases are compared over all documents by a 64-bit hash of their
       words, and the later ones cover what goes.

    A null or blank text has no words. Rows without a doc_id come after all others and are not ordered
    among themselves; rows that repeat a doc_id do not remove from each other. Texts shorter than a
    window lose nothing. Other columns are not used.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    copies = first_copies(docs)
    share = deal(F.struct("doc", F.xxhash64("text")), ceil_div(size, slice_bytes))
    sliced = _marked(docs, copies).where(~F.col("is_copy")).select("doc", "text", share.alias("slice"))
    phrases = recurring_phrases(sliced, window, phrase_words)
    windows = settled(recurring_windows(sliced, phrases, window, phrase_words))
    twice = settled(
        windows.groupBy("h").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    )
    later = windows.join(broadcast_if_small(twice, 16), "h").where("doc > first")
    repeats = settled(later.groupBy("doc").agg(F.collect_list("h").alias("repeats")))
    touched = broadcast_if_small(settled(repeats.select("doc")), 8)
    rows = _marked(docs, copies, "doc_id")
    nothing = F.array().cast("array<long>").alias("repeats")
    own = [
        rows.join(touched, "doc", "left_anti").select("doc_id", "text", "is_copy", nothing),
        rows.join(touched, "doc", "left_semi").join(repeats, "doc").select("doc_id", "text", "is_copy", "repeats"),
    ]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            copied = batch.column("is_copy").to_pylist()
            for text, repeated, is_copy in zip(batch.column("text"), batch.column("repeats"), copied, strict=True):
                kept = words = split_words(text.as_py())
                if is_copy and len(words) >= window:
                    kept = []
                elif len(repeated) and len(words) >= window:
                    gone = covered(words, repeated.values.to_numpy().view(np.uint64), window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            n, removed, sha, joined = zip(*out, strict=True) if out else ((), (), (), ())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(joined, pa.binary())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    done = own[0].mapInArrow(keep, shape).unionByName(own[1].mapInArrow(keep, shape))
    return done.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else done
