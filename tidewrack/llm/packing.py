"""Packing tokenised documents into sequences: best fit, then swap-based local search."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import ceil_div, deal, settled, worker_kept

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, part int, bin int, fill long, offset long"


# -- tokens -----------------------------------------------------------------------------------------


class Remembered(dict):
    """What is known; `make` gives what is not."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class WordwiseEncoder:
    """Byte-level BPE ids of texts, from a `tokenizers` file, encoding each distinct word once.

    A text is cut at the file's added tokens first, as its own tokenizer does. A token never spans a
    space that a visible character follows, so what is between is cut there and the ids of its parts
    are looked up. A line feed between visible characters, and a last mark after a letter or digit,
    are tokens of their own, so what stands around them is looked up before it is encoded. The
    look-up holds two generations of about `held_bytes` each; parts still in use move on to the newer one.
    """

    def __init__(self, path: str, held_bytes: int = 48 << 20) -> None:
        # Tasks keep the cores busy already; threads of its own would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.blank_run = re.compile(r" (?:\s|$)").search
        self.cut_between = re.compile(r"(?<=\S) (?=\S)").split
        self.known, self.older = Remembered(self._make), {}
        self.held_bytes, self.bytes = held_bytes, 0
        self.marks = {m: self._ids([m])[0].tobytes() for m in ".,;:!?"}
        self.feed = self._ids(["\n"])[0].tobytes()

    def _cut(self, text: str) -> list[str]:
        """The parts of a text between such spaces; where blanks follow one another, only between
        visible characters."""
        return self.cut_between(text) if self.blank_run(text) else text.split(" ")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _make(self, part: str) -> bytes:
        """The ids of a part that is not in the newer generation: after a space, or, if it starts with a
        line feed, those of what follows it."""
        known = self.known
        ids = self.older.get(part)
        if ids is None:
            if "\n" in part[1:] and (own := part.split("\n")) == part.split():
                # Not kept: such parts rarely come again.
                return self.feed.join([known[own[0]], *[known["\n" + x] for x in own[1:]]])
            head = part[:1] == "\n"
            word = part[1:] if head else part
            if part[-1:] in self.marks and part[-2:-1].isalnum() and part[-2] < "\u0530":
                ids = known[part[:-1]] + self.marks[part[-1]]
            elif word.isalpha() and word.isascii():
                # Letters only are one word for the file's model.
                ids = array("I", [t.id for t in self.model.tokenize(word if head else "Ġ" + word)]).tobytes()
            else:
                ids = self._ids([word if head else " " + word])[0].tobytes()
        known[part] = ids
        self.bytes += 160 + len(part) + len(ids)  # the entry and its objects, about
        return ids

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that hold no added token."""
        if self.bytes > self.held_bytes:
            self.known, self.older, self.bytes = Remembered(self._make), dict(self.known), 0
        cut = [self._cut(t) for t in texts]
        look = self.known.__getitem__
        heads = self._ids([parts[0] for parts in cut])
        return [h.tobytes() + b"".join(map(look, parts[1:])) for h, parts in zip(heads, cut, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if self.added is None or not any(map(self.added.search, texts)):
            return self._plain(texts)
        pieces = [self.added.split(t) for t in texts]  # what is between them, and every second one a token
        between = iter(self._plain([p for own in pieces for p in own[::2]]))
        out = []
        for own in pieces:
            ids = [next(between)]
            for token in own[1::2]:
                ids += [np.array([self.tokenizer.token_to_id(token)], dtype="<u4").tobytes(), next(between)]
            out.append(b"".join(ids))
        return out


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, cut only where longer than `capacity`.

    A document is the ids of its text and `end_id`; a null text is empty. Of a longer document the
    first piece takes what is over, the others are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_kept(("encoder", tokenizer_path), lambda: WordwiseEncoder(tokenizer_path))
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = []
                encoded = encoder.encode([t or "" for t in some.column("text").to_pylist()])
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += last
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = capacity if start else (n - 1) % capacity + 1
                        out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(out, columns=names), schema=shape, preserve_index=False
                )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shape = pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# -- one group of items ------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []  # that some open bin has, ascending
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        at = bisect_left(spaces, need)
        if at < len(spaces):
            space = spaces[at]
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces.pop(at)
            bins[chosen].append(item)
        else:
            space, chosen = capacity, len(bins)
            bins.append([item])
        left = space - need
        if left:
            if not by_space[left]:
                insort(spaces, left)
            by_space[left].append(chosen)
    return bins


class _Underfull:
    """The bins with space left, by the size of each item and of each two items they hold."""

    def __init__(self, capacity: int) -> None:
        self.held = ({}, {})  # sizes of one item, sums of two: bins that have it, as ordered sets
        self.mask = [0, 0]  # bit n is set if some bin has n

    @staticmethod
    def units(sizes: Counter) -> tuple[list[int], list[int]]:
        one = sorted(sizes)
        two = {a + b for n, a in enumerate(one) for b in one[n + 1 :]} | {2 * a for a in one if sizes[a] > 1}
        return one, sorted(two)

    def add(self, number: int, sizes: Counter) -> None:
        for many, units in enumerate(self.units(sizes)):
            for n in units:
                self.held[many].setdefault(n, {})[number] = None
                self.mask[many] |= 1 << n

    def remove(self, number: int, sizes: Counter) -> None:
        for many, units in enumerate(self.units(sizes)):
            for n in units:
                own = self.held[many][n]
                del own[number]
                if not own:
                    self.mask[many] &= ~(1 << n)

    def largest(self, many: int, most: int) -> int:
        """The largest size up to `most` that a bin has, or -1."""
        return (self.mask[many] & ((1 << (most + 1)) - 1)).bit_length() - 1


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins while squared fill grows, until bins empty.

    The fullest bin with space left takes what fills it best: it gives none, one or two items for
    one of another bin, or none or one for two of another bin (a move, one for one, two for one).
    The sum of squared fills grows with each exchange, so space gathers in few bins and these
    empty. Ends when no bin has such an exchange, or when no fewer bins could hold the items. All
    underfull bins and all their items take part, equal sizes as one.
    """
    size = [int(x) for x in lengths]
    fill = [sum(size[i] for i in b) for b in bins]
    items: list[dict[int, list[int]]] = []
    for b in bins:
        own: dict[int, list[int]] = {}
        for i in b:
            own.setdefault(size[i], []).append(i)
        items.append(own)
    sizes = [Counter({n: len(i) for n, i in own.items()}) for own in items]
    fewest, count = -(-sum(fill) // capacity), sum(1 for f in fill if f)
    index = _Underfull(capacity)
    waiting = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
    for b in waiting:
        index.add(b, sizes[b])
    queue = [(-fill[b], b) for b in waiting]
    heapify(queue)

    def parts(b: int, total: int, many: int) -> tuple[int, ...]:
        """Sizes of `many` items of bin b that sum to `total`."""
        if many < 2:
            return (total,) * many
        one = next(n for n in sizes[b] if total - n in sizes[b] and (2 * n != total or sizes[b][n] > 1))
        return one, total - one

    def shift(frm: int, to: int, moved: tuple[int, ...]) -> None:
        for n in moved:
            item = items[frm][n].pop()
            sizes[frm][n] -= 1
            if not sizes[frm][n]:
                del sizes[frm][n], items[frm][n]
            items[to].setdefault(n, []).append(item)
            sizes[to][n] += 1

    def best_exchange(b: int) -> tuple | None:
        """(gain, sizes given, other bin, sizes taken) of the exchange that fills bin b most, among
        those that let squared fill grow: the other bin must be less full than b will be."""
        space, best, gain = capacity - fill[b], None, 0
        one, two = _Underfull.units(sizes[b])
        options = [
            (given, given_many, taken_many)
            for given, given_many in [(0, 0), *((n, 1) for n in one), *((n, 2) for n in two)]
            for taken_many in ((1, 2) if given_many < 2 else (1,))
        ]
        for given, given_many, taken_many in options:
            taken = index.largest(taken_many - 1, given + space)
            while taken - given > gain:
                # Of the bins that have it, one of the first few with the least fill.
                other = min(islice(index.held[taken_many - 1][taken], 16), key=fill.__getitem__)
                if fill[other] < fill[b] + taken - given:
                    gain = taken - given
                    best = gain, parts(b, given, given_many), other, parts(other, taken, taken_many)
                    break
                taken = index.largest(taken_many - 1, taken - 1)
            if gain == space:
                break
        return best

    moved = True
    while moved and count > fewest:
        moved, idle = False, []
        while queue and count > fewest:
            key, b = heappop(queue)
            if -key != fill[b] or not 0 < fill[b] < capacity:
                continue
            index.remove(b, sizes[b])
            found = best_exchange(b)
            if found is None:
                index.add(b, sizes[b])
                idle.append((key, b))
                continue
            gain, back, other, there = found
            index.remove(other, sizes[other])
            shift(b, other, back)
            shift(other, b, there)
            fill[b] += gain
            fill[other] -= gain
            moved = True
            for c in (b, other):
                if 0 < fill[c] < capacity:
                    index.add(c, sizes[c])
                    heappush(queue, (-fill[c], c))
            count -= not fill[other]
        queue = idle + queue
        heapify(queue)
    return [[i for own in b.values() for i in own] for b in items if b]


def pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The rows with `bin`, `fill` and `offset`: bins numbered in the group, offsets without gaps."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    frame = frame.reset_index(drop=True)
    lengths = frame["length"].to_numpy()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    order = np.fromiter((i for b in bins for i in b), dtype=np.int64, count=len(frame))
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    out = frame.iloc[order].copy()
    own = lengths[order]
    before = np.cumsum(own) - own
    first = np.searchsorted(number, number)
    fill = np.bincount(number, own).astype(np.int64) if len(own) else own
    out["bin"], out["fill"], out["offset"] = number.astype(np.int32), fill[number], before - before[first]
    return out


# -- the operator -----------------------------------------------------------------------------------


def packed(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, group_items: int = 65_536,
    loose: float = 0.995,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece in one sequence.

    Full pieces are sequences of their own. The others are dealt by hash into groups of about
    `group_items`, each packed in one task; then the items of all bins filled below `loose` are dealt
    and packed again, in ever fewer groups, until the remainders of all groups have met in one. A
    group holds ids and lengths only.
    Added tokens of the file that stand in a text are such tokens, as the file has it. A null text is
    a document of `end_id` alone; repeated rows and rows without an id are documents
    of their own. An empty table gives no rows. Other columns of `docs` are not used.
    """
    pieces = settled(tokenised_pieces(docs, tokenizer_path, capacity, end_id))
    whole = F.col("length") == capacity

    names = [c.split()[0] for c in PLACED.split(", ")]
    place = lambda frame: pack_group(frame, capacity)[names]
    key = F.struct("doc_id", "piece", "ids_crc32")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    tight = F.col("fill") >= int(loose * capacity)
    left, placed, turn = pieces.where(~whole), [], 0
    groups = ceil_div(left.count(), group_items)
    while True:
        done = settled(
            left.withColumn("part", deal(key, groups)).groupBy("part").applyInPandas(place, PLACED)
        )
        # What no other group can help is placed; the rest meets again, until one group has it all.
        open_bins = done.where(~tight)
        more = ceil_div(open_bins.count(), group_items)
        last = groups == 1 or more >= groups
        kept = done if last else done.where(tight)
        number = F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
        placed.append(kept.select(*columns, (number * 64 + turn).alias("sequence_id"), "offset"))
        if last:
            break
        left, groups, turn = open_bins.drop("part", "bin", "fill", "offset"), more, turn + 1
    own_bin = (F.monotonically_increasing_id() * 64 + 63).alias("sequence_id")
    result = pieces.where(whole).select(*columns, own_bin, F.lit(0).cast("long").alias("offset"))
    for part in placed:
        result = result.unionByName(part)
    return result
