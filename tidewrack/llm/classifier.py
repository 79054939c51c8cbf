"""A quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled

#: Bins per structure statistic.
BINS = 12
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_WORDLIKE = _UPPER + _LOWER + _DIGIT + b" \t\r\n\x0b\x0c.,;:'\"-!?()" + bytes(range(128, 256))
_MARKS = re.compile(rb"(\S)\1\1")


@dataclass(frozen=True)
class Settings:
    """max_labelled bounds the labelled rows the model is fitted on; every document is scored."""

    words: int = 1 << 16
    rank: int = 8
    max_labelled: int = 20_000
    epochs: int = 6
    least_steps: int = 1_200
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 5


def statistics(text: bytes, words: list[bytes], counts: Counter) -> np.ndarray:
    """What the text looks like: lengths, and shares of kinds of characters, words and lines."""
    size, n = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda kind: (size - len(text.translate(None, kind))) / size
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n,
        share(_UPPER), share(_LOWER), share(_DIGIT), 1.0 - share(_WORDLIKE),
        len(counts) / n, max(counts.values(), default=0) / n,
        len(lines) / n, len(set(lines)) / max(1, len(lines)),
        len(_MARKS.findall(text)) / n, text.count(b"|") / n, (text.count(b"!") + text.count(b"?")) / n,
        (text.count(b".") + text.count(b",")) / n, sum(map(len, counts)) / max(1, len(counts)),
    ])


def features(text: bytes | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words with weights of unit length, and the structure statistics."""
    text = text or b""
    words = text.split()
    counts = Counter(words)
    index = np.fromiter((zlib.crc32(w) for w in counts), dtype=np.int64, count=len(counts)) % buckets
    weight = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    length = np.sqrt((weight * weight).sum())
    return index, weight / length if length else weight, statistics(text, words, counts)


class Model:
    """score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, in time linear in the features."""

    def __init__(self, s: Settings, edges: np.ndarray) -> None:
        size = s.words + edges.shape[0] * (BINS + 1)
        self.s, self.edges = s, edges
        self.w = np.zeros(size)
        self.v = np.random.default_rng(s.seed).normal(0, 0.05, (size, s.rank))
        self.w0 = 0.0

    def join(self, words: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One index and weight list: the words, then each statistic as the bin it falls in."""
        bins = (stats[:, None] > self.edges).sum(1) + np.arange(len(stats)) * (BINS + 1) + self.s.words
        return np.concatenate([words, bins]), np.concatenate([weights, np.full(len(bins), 0.5)])

    def raw(self, i: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[i] * x[:, None]
        total = vx.sum(0)
        return float(self.w0 + self.w[i] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: bytes | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(*self.join(*features(text, self.s.words))), -30, 30))))

    def fit(self, index: np.ndarray, weight: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> None:
        """Logistic loss by AdaGrad over shuffled batches, in `least_steps` or more.

        The features of all rows stand one after the other; `ends` says where each row's end.
        """
        starts_of = np.concatenate([[0], ends[:-1]])
        s, rng = self.s, np.random.default_rng(self.s.seed)
        gw, gv, g0 = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(max(s.epochs, -(-s.least_steps * s.batch // max(1, len(ends))))):
            order = rng.permutation(len(ends))
            for at in range(0, len(order), s.batch):
                batch = order[at : at + s.batch]
                i = np.concatenate([index[starts_of[b] : ends[b]] for b in batch])
                x = np.concatenate([weight[starts_of[b] : ends[b]] for b in batch]).astype(float)
                starts = np.cumsum([0, *(ends[batch] - starts_of[batch])[:-1]])
                row = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(i))))
                vx = self.v[i] * x[:, None]
                total = np.add.reduceat(vx, starts)
                squares = np.add.reduceat((vx * vx).sum(1), starts)
                raw = self.w0 + np.add.reduceat(self.w[i] * x, starts) + 0.5 * ((total * total).sum(1) - squares)
                slope = (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
                each = slope[row] * x
                used, place = np.unique(i, return_inverse=True)
                dw = np.bincount(place, each) + s.decay * self.w[used]
                dv = np.stack([np.bincount(place, each * (total[row, f] - vx[:, f])) for f in range(s.rank)], axis=1)
                dv += s.decay * self.v[used]
                d0 = slope.sum()
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += d0 * d0
                self.w[used] -= s.rate * dw / np.sqrt(gw[used])
                self.v[used] -= s.rate * dv / np.sqrt(gv[used])
                self.w0 -= s.rate * d0 / np.sqrt(g0)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled documents that are not held out.

    If there are more than `max_labelled` of them, a share chosen by hash is used. Labels without an
    id or a quality are left out; of several labels of an id, the majority counts (1 if even). With
    labels of one kind only, or none, scores tend to that kind, or to a half.
    """
    s = settings
    known = settled(
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("quality"))
    )
    total = known.count()
    if total > s.max_labelled:
        known = settled(
            known.where(F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 20)) < int((1 << 20) * s.max_labelled / total))
        )
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    chosen = texts.join(broadcast_if_small(known, 16), "doc_id").select("doc_id", "quality", "text")
    words = s.words

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("quality"),
                    pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "quality", "words", "weights", "stats"],
            )

    shape = "doc_id long, quality int, words array<int>, weights array<float>, stats array<double>"
    rows = settled(chosen.mapInArrow(measure, shape))
    # About max_labelled rows at most, as sparse features; in the order of their ids.
    taken = rows.toArrow().sort_by([("doc_id", "ascending")])
    if not len(taken):
        return Model(s, np.zeros((len(statistics(b"", [], Counter())), BINS)))
    stats = np.stack([x.values.to_numpy() for x in taken.column("stats")])
    model = Model(s, np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T)
    # Joined in single precision into a few large arrays, which go back to the system after the fit.
    sizes = np.array([len(w) for w in taken.column("words")]) + stats.shape[1]
    ends = np.cumsum(sizes)
    index, weight = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    for w, x, t, a, b in zip(taken.column("words"), taken.column("weights"), stats, ends - sizes, ends, strict=True):
        index[a:b], weight[a:b] = model.join(w.values.to_numpy(), x.values.to_numpy(), t)
    quality = taken.column("quality").to_numpy().astype(float)
    del taken, w, x
    pa.default_memory_pool().release_unused()
    model.fit(index, weight, ends, quality)
    return model


def _scorer(docs: DataFrame, model: Model):
    """What gives the model in a task; it is broadcast, in single precision, at a fixed size.

    What is broadcast is plain numbers and arrays: a class would travel by name, and executors need
    no copy of this package.
    """
    parts = (astuple(model.s), model.edges, model.w.astype(np.float32), model.v.astype(np.float32), model.w0)
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def own() -> Model:
        here = Model.__new__(Model)
        settings, here.edges, here.w, here.v, here.w0 = sent.value
        here.s = Settings(*settings)
        return here

    return own


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`, scored over its whole text.

    Only the text makes a score. Null, empty and blank texts are scored as a text without words.
    Repeated rows score alike. Other columns of both tables are not used.
    """
    scorer = _scorer(docs, fit(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"]
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """The rows of `docs` with all their columns whose score is at least `threshold`."""
    scorer = _scorer(docs, fit(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            yield batch.filter(pa.array([own.score(t.as_py()) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
