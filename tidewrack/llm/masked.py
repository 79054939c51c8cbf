"""Masked pseudo-likelihood: a bidirectional window network predicts each word from both sides."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import settled

#: A word code is three digits of this base, predicted one after the other.
BASE = 32
CODES = BASE**3
#: The last codes are shared, by hash, by the words outside the vocabulary.
SHARED = 1024
PAD = CODES
#: So many words outside the vocabulary are looked up once by each task; the others again.
KEPT = 100_000
BLOCK = 8192
FAN_IN = 64


@dataclass(frozen=True)
class Settings:
    """reach: words seen on each side. rounds: the documents are dealt into this many passes, and
    the networks that the partitions trained are averaged after each."""

    reach: int = 2
    width: int = 16
    batch: int = 2_048
    rate: float = 0.15
    rounds: int = 2
    seed: int = 3


# -- vocabulary -------------------------------------------------------------------------------------


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def vocabulary(docs: DataFrame) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """The most frequent words of all documents (ties in byte order), for all codes that are not
    shared, how often each code occurs, and (word, log_share) of all other words: the log of a
    word's part of the occurrences of its shared code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(words_of(text.as_py()))
                if len(held) > 200_000:
                    yield from give(held)
                    held = Counter()
        yield from give(held)

    def give(held: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())
        for at in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([words[at : at + 20_000], counts[at : at + 20_000]], names=["word", "n"])

    counted = settled(_texts(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    best = counted.orderBy(F.desc("n"), "word").limit(CODES - SHARED).collect()  # at most CODES words
    counts = np.zeros(CODES)
    counts[: len(best)] = [r["n"] for r in best]
    rest = counted.where(F.lit(False))
    if len(best) == CODES - SHARED:
        n, word = F.lit(best[-1]["n"]), F.lit(bytearray(best[-1]["word"]))
        rest = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
    rest = rest.withColumn("code", CODES - SHARED + F.crc32("word") % SHARED)
    shared = settled(rest.groupBy("code").agg(F.sum("n").alias("code_n")))  # at most SHARED rows
    for r in shared.collect():
        counts[r["code"]] = r["code_n"]
    shares = rest.join(F.broadcast(shared), "code").select("word", F.log(F.col("n") / F.col("code_n")).alias("log_share"))
    return [bytes(r["word"]) for r in best], counts, settled(shares)


class Codes(dict):
    """The code of each word; frequent words first, spread over the first digit."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.kept = len(words) + KEPT

    def __missing__(self, word: bytes) -> int:
        code = CODES - SHARED + zlib.crc32(word) % SHARED
        if len(self) < self.kept:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


# -- the network ------------------------------------------------------------------------------------


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below 2^16, and the sums of their rows."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(np.take(rows, order, axis=0), starts)


#: Adds up the chances of each of the three digits.
DIGITS = np.kron(np.eye(3, dtype=np.float32), np.ones((BASE, 1), np.float32))
#: Exponentials of logits within this of zero neither overflow nor vanish.
SAFE = 60.0


class Network:
    """p(word | both sides) = p(digit 1 | h) p(digit 2 | h, digit 1) p(digit 3 | h, digits 1 and 2)."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.offsets = np.array([o for o in range(-s.reach, s.reach + 1) if o])
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embedding": normal(CODES + 1, s.width, scale=0.1),
            "place": np.ones((len(self.offsets), s.width), np.float32) + normal(len(self.offsets), s.width, scale=0.1),
            "bias": np.zeros(s.width, np.float32),
            "out": normal(s.width, 3 * BASE, scale=0.1),
            "first": np.zeros((1, BASE), np.float32),
            "second": np.zeros((BASE, BASE), np.float32),
            "third": np.zeros((BASE * BASE, BASE), np.float32),
        }
        self.p["embedding"][PAD] = 0
        self.squares = {k: np.full((len(v), 1), 1e-3, np.float32) for k, v in self.p.items() if k != "bias"}

    def begin_with(self, counts: np.ndarray) -> None:
        """Make the untrained network give each code its share of the corpus."""
        c = (counts + 0.1).reshape(BASE, BASE, BASE).transpose(2, 1, 0)  # by digit 1, 2, 3
        share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
        self.p["first"] = share(c.sum((1, 2)))[None]
        self.p["second"] = share(c.sum(2))
        self.p["third"] = share(c).reshape(BASE * BASE, BASE)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def forward(self, stream: np.ndarray, at: np.ndarray):
        """Exponentials of the digits' logits at positions `at` of a stream padded by `reach` on both
        ends, and their sums over each digit: shares of them are the probabilities."""
        p, y = self.p, stream[at]
        around = stream[at[:, None] + self.offsets]
        seen = np.take(p["embedding"], around, axis=0)
        h = np.tanh(np.einsum("nod,od->nd", seen, p["place"]) + p["bias"])
        digits = np.stack([y % BASE, y // BASE % BASE, y // (BASE * BASE)], axis=1)
        upper = digits[:, 0] * BASE + digits[:, 1]
        logits = (h @ p["out"]).reshape(len(at), 3, BASE)
        logits[:, 0] += p["first"][0]
        logits[:, 1] += np.take(p["second"], digits[:, 0], axis=0)
        logits[:, 2] += np.take(p["third"], upper, axis=0)
        if logits.size and max(logits.max(), -logits.min()) > SAFE:
            logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits.reshape(len(at), -1) @ DIGITS, digits, upper, around, seen, h

    def log_probabilities(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        chances, sums, digits, *_ = self.forward(stream, at)
        picked = np.take_along_axis(chances, digits[:, :, None], axis=2)[:, :, 0] / sums
        return np.log(np.maximum(picked, 1e-30)).sum(axis=1, dtype=np.float64)

    def _step(self, name: str, rows: np.ndarray | slice, g: np.ndarray) -> None:
        squares = self.squares[name]
        grown = squares[rows] + (np.einsum("ij,ij->i", g, g) / g.shape[1])[:, None]
        squares[rows] = grown
        self.p[name][rows] -= g * (self.s.rate / np.sqrt(grown))

    def learn(self, stream: np.ndarray, at: np.ndarray) -> None:
        """One step on these positions: row-wise AdaGrad."""
        p, every = self.p, slice(None)
        g, sums, digits, upper, around, seen, h = self.forward(stream, at)
        g *= (1 / (sums * len(at)))[:, :, None]
        g.ravel()[np.arange(0, g.size, BASE) + digits.ravel()] -= 1 / len(at)
        flat = g.reshape(len(at), -1)
        dx = (flat @ p["out"].T) * (1 - h * h)
        back = (dx[:, None, :] * p["place"]).reshape(-1, self.s.width)
        place = np.einsum("nod,nd->od", seen, dx)
        self._step("out", every, h.T @ flat)
        self._step("first", every, g[:, 0].sum(0, keepdims=True))
        self._step("second", *_summed(digits[:, 0], g[:, 1]))
        self._step("third", *_summed(upper, g[:, 2]))
        self._step("place", every, place)
        self._step("embedding", *_summed(around.ravel(), back))
        p["bias"] -= self.s.rate * dx.sum(0)
        p["embedding"][PAD] = 0


def _stream(codes: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes in a row with `reach` pads around each text, and the positions of the codes."""
    gap = np.full(reach, PAD, np.int32)
    parts, at, place = [gap], [], reach
    for c in codes:
        parts += [c, gap]
        at.append(np.arange(place, place + len(c)))
        place += len(c) + reach
    return np.concatenate(parts), np.concatenate(at) if at else np.zeros(0, np.int64)


# -- training and scoring ---------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def _averaged(trained: DataFrame) -> np.ndarray | None:
    """The mean of the partitions' parameters, weighted by their words: FAN_IN at a time, block by block."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        weight = frame["weight"].to_numpy()
        rows = np.stack([np.frombuffer(v, np.float32) for v in frame["values"]])
        value = (weight @ rows / weight.sum()).astype(np.float32)
        return pd.DataFrame({
            "part": [frame["part"].iloc[0]], "block": [frame["block"].iloc[0]], "weight": [weight.sum()],
            "values": [value.tobytes()],
        })

    parts = trained.agg(F.max("part")).first()[0]
    if parts is None:
        return None
    while True:
        trained = trained.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        trained = settled(trained.groupBy("part", "block").applyInPandas(mean, TRAINED))
        parts //= FAN_IN
        if not parts:
            break
    # One mean of each block is left: the size of the network.
    rows = sorted(trained.select("block", "values").collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])


RARE = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
TRAINED = "part int, block int, weight double, values binary"


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[list[bytes], DataFrame, Network | None]:
    """The vocabulary of all documents, the shares of the words outside it, and the network trained
    on every word of them.

    Each partition trains a copy on its documents; the copies are averaged, and the next round goes
    on from the mean with the next share of the documents. None if there are no words.
    """
    s, spark = settings, docs.sparkSession
    words, counts, shares = vocabulary(docs)
    network, learned = Network(s), False
    network.begin_with(counts)
    for turn in range(s.rounds):
        sent = spark.sparkContext.broadcast((words, network.flat()))  # fixed size

        def fit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, flat = sent.value
            codes, own, seen = Codes(known), Network(s), 0
            own.load(flat)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = [codes.of(words_of(t.as_py())) for t in batch.column("text")[lo : lo + 256]]
                    stream, at = _stream([c for c in some if len(c)], s.reach)
                    for a in range(0, len(at), s.batch):
                        own.learn(stream, at[a : a + s.batch])
                    seen += len(at)
            if seen:
                values, part = own.flat(), TaskContext.get().partitionId()
                blocks = [values[a : a + BLOCK].tobytes() for a in range(0, len(values), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()),
                        pa.array([float(seen)] * n), pa.array(blocks, pa.binary()),
                    ],
                    names=["part", "block", "weight", "values"],
                )

        share = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.rounds)) == turn)
        mean = _averaged(settled(_texts(share).mapInArrow(fit, TRAINED)))
        if mean is not None:
            network.load(mean)
            learned = True
    return words, shares, network if learned else None


def pseudo_likelihood(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) per row of `docs`.

    log_likelihood is the sum, over all words of the whole text, of the natural log of the
    probability the network gives the word from the words on both sides of it. Words are lower-cased
    (A-Z) runs between white space. Rare ones share codes; the probability of the code is divided
    among its words by their counts in all of `docs`, which stay in Spark. A word has been counted
    if it is scored, so none is unseen.
    Null, empty and blank texts have no words, a sum of zero and no mean. Repeated rows score alike.
    Other columns are not used.
    """
    words, shares, network = train(docs, settings)
    s = settings
    own_codes = CODES - SHARED
    sent = docs.sparkSession.sparkContext.broadcast((words, None if network is None else network.flat()))  # fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = sent.value
        codes, own = Codes(known), Network(s)
        if flat is not None:
            own.load(flat)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                split = [words_of(t.as_py()) for t in batch.column("text")[lo : lo + 256]]
                some = [codes.of(w) for w in split]
                rare = [
                    list(Counter(w[i] for i in np.flatnonzero(c >= own_codes)).items())
                    for w, c in zip(split, some, strict=True)
                ]
                stream, at = _stream(some, s.reach)
                each = [own.log_probabilities(stream, at[a : a + 8192]) for a in range(0, len(at), 8192)]
                ends = np.cumsum([len(c) for c in some])
                running = np.concatenate([[0.0], np.cumsum(np.concatenate(each) if each else np.zeros(0))])
                total = running[ends] - running[ends - [len(c) for c in some]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo : lo + 256], pa.array([len(c) for c in some], pa.int64()), pa.array(total),
                        pa.array([[{"word": w, "times": n} for w, n in r] for r in rare], RARE),
                    ],
                    names=["doc_id", "n_words", "code_likelihood", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    shape = f"doc_id {kind}, n_words long, code_likelihood double, rare array<struct<word: binary, times: long>>"
    scored = settled(rows.mapInArrow(score, shape).withColumn("row", F.monotonically_increasing_id()))
    # A rare word makes up a small part of all words, so no key of this join is hot.
    parts = (
        scored.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.times")
        .join(shares, "word")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.col("times") * F.col("log_share"))).alias("parts"))
        .select("row", F.aggregate("parts", F.lit(0.0), lambda t, x: t + x).alias("divided"))
    )
    return (
        scored.drop("rare")
        .join(parts, "row", "left")
        .withColumn("log_likelihood", F.col("code_likelihood") + F.coalesce("divided", F.lit(0.0)))
        .select(
            "doc_id", "n_words", "log_likelihood",
            F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("per_word"),
        )
    )
