"""Helpers that several training-data operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.session import settled

#: Rows of at most this many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, never broadcast by the joins it is in.

    Spark takes a written table for as large as its files and a generator's rows for as many as it
    reads, so it broadcasts tables by itself that are many times what the driver can hold.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else `shuffled`.

    `df` should be a settled table, so that counting it reads metadata only; or else `rows` says how
    many rows it has at most.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else shuffled(df)


def vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id long, v array<double>): one row per id, whose vector can take part.

    Rows with a null id, and vectors that are null, empty or hold a null or non-finite component,
    are left out. Of several vectors of one id the smallest (element by element) counts.
    """
    v = F.col(vector_column)
    usable = v.isNotNull() & (F.size(v) > 0) & F.col(id_column).isNotNull()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        embeddings.where(usable)
        .where(finite)
        .groupBy(F.col(id_column).cast("long").alias("vec_id"))
        .agg(F.min(v.cast("array<double>")).alias("v"))
    )


def deal(key: Column, parts: Column | int) -> Column:
    """A stable share 0..parts-1 of the rows, by hash of `key`."""
    parts = F.lit(parts) if isinstance(parts, int) else parts
    return F.pmod(F.xxhash64(key), parts.cast("long")).cast("int")


def worker_kept(key: Hashable, make: Callable[[], object]):
    """A value that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def ceil_div(a: int, b: int) -> int:
    return max(1, -(-a // b))


def whole_groups(
    batches: Iterator[pd.DataFrame], key: list[str], least_rows: int = 50_000
) -> Iterator[pd.DataFrame]:
    """Regroups the batches of a partition sorted by `key`, so that no group is cut in two.

    Each frame given out has some `least_rows` rows (the last fewer) plus the rest of its last group.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least_rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame[key].iloc[-1]
        same = (frame[key] == last).all(axis=1).to_numpy()
        cut = len(frame) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
            frame = frame.iloc[cut:].reset_index(drop=True)
        held, rows = [frame], len(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


__all__ = [
    "BROADCAST_BYTES", "broadcast_if_small", "ceil_div", "deal", "settled", "shuffled", "vectors", "whole_groups",
    "worker_kept",
]
