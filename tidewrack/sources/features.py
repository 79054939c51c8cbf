"""Features of JSON collections of any size: one file is read by many tasks.

Spark's text reader deals a file out in byte ranges of records that end at an opening brace, so no
task needs the whole of it. A first pass tells what each range does to the state of a JSON reader
(inside a string or not, how many brackets are open), whichever state it starts in; folding these
few rows gives every range its state. A second pass cuts the ranges at the borders of features, and
the features that span several ranges are put together by a shuffle of their pieces alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A feature is an object in an array of an object: two brackets are open around it.
AROUND = 2
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+("?)', re.S)
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+("?)', re.S)
PLACE = "file string, block long"


def bracket_steps(text: bytes, in_string: bool) -> tuple[np.ndarray, bool]:
    """+1 and -1 for each byte that opens and closes a bracket outside strings, and the state after."""
    steps, at = _STEP[np.frombuffer(text, np.uint8)], 0
    if in_string:
        rest = _REST_OF_STRING.match(text)
        steps[: rest.end()] = 0
        at = rest.end()
        if not rest.group(1):
            return steps, True
    for string in _STRING.finditer(text, at):
        steps[string.start() : string.end()] = 0
        if not string.group(1):
            return steps, True
    return steps, False


class Reader:
    """The state of reading a collection: inside a string, and the brackets open."""

    def __init__(self, in_string: bool, depth: int) -> None:
        self.in_string, self.depth = in_string, depth
        self.opened: Counter[int] = Counter()  # braces by the brackets open before them

    def take(self, text: bytes, brace: bool) -> tuple[bool, np.ndarray]:
        """Read a record (after its brace, if it has one): whether the brace opened an object, and
        the brackets open after each of its bytes."""
        opens = brace and not self.in_string
        if opens:
            self.opened[self.depth] += 1
            self.depth += 1
        steps, self.in_string = bracket_steps(text, self.in_string)
        depths = self.depth + np.cumsum(steps, dtype=np.int64)
        if len(depths):
            self.depth = int(depths[-1])
        return opens, depths


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) of the text between braces, in order within each byte range."""
    text = spark.read.option("lineSep", "{").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple[bytes, bool]]]]:
    """(place, its records with whether a brace comes before each) of every byte range of a partition."""

    def rows() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            yield from zip(zip(files, blocks, strict=True), (v.as_py() for v in batch.column("value")), strict=True)

    from itertools import groupby

    for place, own in groupby(rows(), key=lambda r: r[0]):
        # Only the record a file begins with has no brace before it.
        yield place, ((text, n > 0 or place[1] > 0) for n, (_, text) in enumerate(own))


def _transitions(records: DataFrame) -> DataFrame:
    """What each byte range does, if it starts outside (0) or inside (1) a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _ranges(batches):
            states = Reader(False, 0), Reader(True, 0)
            for text, brace in own:
                for state in states:
                    state.take(text, brace)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "file": file, "block": block, "started": start, "in_string": state.in_string,
                        "depth": state.depth, "opened": list(state.opened.items()),
                    }
                    for start, state in zip((False, True), states, strict=True)
                ],
                schema=pa.schema([
                    ("file", pa.string()), ("block", pa.int64()), ("started", pa.bool_()), ("in_string", pa.bool_()),
                    ("depth", pa.int64()), ("opened", pa.map_(pa.int64(), pa.int64())),
                ]),
            )

    shape = f"{PLACE}, started boolean, in_string boolean, depth long, opened map<long, long>"
    return records.mapInArrow(run, shape)


def _starts(records: DataFrame) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(in a string, brackets open, features begun before) at the start of every byte range.

    Folds two rows per range, of 128 MB by default. A file that does not end as it began is an error.
    """
    rows = {(r.file, r.block, r.started): r for r in _transitions(records).collect()}
    starts, last, state = {}, None, (False, 0, 0)
    for file, block in sorted({(f, b) for f, b, _ in rows}):
        if file != last:
            _check_end(last, state)
            last, state = file, (False, 0, 0)
        starts[file, block] = state
        own = rows[file, block, state[0]]
        state = own.in_string, state[1] + own.depth, state[2] + own.opened.get(AROUND - state[1], 0)
    _check_end(last, state)
    return starts


def _check_end(file: str | None, state: tuple[bool, int, int]) -> None:
    if state[0] or state[1]:
        raise ValueError(f"{file} ends inside {'a string' if state[0] else 'brackets'}: its features cannot be told apart")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, value): the text of each object in an array of a collection, numbered per file.

    Files hold collections one after the other, on any number of lines; a file is read in as many
    byte ranges as Spark makes of it. Only the pieces of features that cross ranges are shuffled.
    """
    records = _records(spark, path)
    starts = _starts(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _ranges(batches):
            in_string, depth, begun = starts[file, block]
            state = Reader(in_string, depth)
            number, whole = begun - 1, depth <= AROUND
            held: list[bytes] = []  # of the feature that is open
            out: list[tuple[int, bool, bytes]] = []
            for text, brace in own:
                before = state.depth
                opens, depths = state.take(text, brace)
                if opens and before == AROUND:
                    number, whole, held = number + 1, True, []
                if before > AROUND or (opens and before == AROUND):
                    held.append(b"{" + text if brace else text)
                    ends = np.flatnonzero(depths <= AROUND)
                    if len(ends):
                        held[-1] = held[-1][: int(ends[0]) + 1 + brace]
                        out.append((number, whole, b"".join(held)))
                        held, whole = [], True
                if len(out) >= 1000:
                    yield _pieces(file, block, out)
                    out = []
            if held:
                out.append((number, False, b"".join(held)))
            yield _pieces(file, block, out)

    pieces = records.mapInArrow(run, f"{PLACE}, feature long, whole boolean, value binary")
    parts = pieces.where("NOT whole").groupBy("file", "feature").agg(
        F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["value"]))
    return (
        pieces.where("whole").select("file", "feature", "value")
        .unionByName(parts.select("file", "feature", joined.alias("value")))
        .withColumn("value", F.col("value").cast("string"))
    )


def _pieces(file: str, block: int, rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary()),
        ],
        names=["file", "block", "feature", "whole", "value"],
    )
