"""Whitening of integer vectors by an exact covariance, recovered from variances alone (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import settled

#: Rows whose squares are summed at once; with LIMB it keeps the sums of limbs inside 63 bits.
STRIP = 1024
LIMB = 26
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integer_vectors(
    embeddings: DataFrame, scale: float, shift: int, id_column: str, vector_column: str
) -> DataFrame:
    """(vec_id long, x array<long>): floor(scale * c) + shift of every component of every usable row."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(shift).cast("long")
    return (
        embeddings.where(v.isNotNull() & (F.size(v) > 0))
        .where(finite)
        .select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))
    )


# -- exact sums ---------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, in 64-bit integers where they suffice, else in Python integers."""
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if reach < 2**61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def square_sums(t: np.ndarray, axis: int = 0) -> np.ndarray:
    """Exact sums of squares along an axis of at most STRIP values, as Python integers."""
    if t.dtype != object:
        top = int(np.abs(t).max(initial=0))
        if top * top * t.shape[axis] < 2**63:
            return (t * t).sum(axis).astype(object)
        if top < 2 ** (2 * LIMB) and t.shape[axis] <= STRIP:
            high, low = t >> LIMB, t & ((1 << LIMB) - 1)
            parts = (high * high, high * low, low * low)
            a, b, c = (p.sum(axis).astype(object) for p in parts)
            return (a << 2 * LIMB) + (b << LIMB + 1) + c
    whole = t.astype(object)
    return (whole * whole).sum(axis)


def polarised(d: np.ndarray) -> np.ndarray:
    """Upper triangle: on the diagonal the squares of each column of `d`, beside it those of the sums
    of two columns, added up over the rows."""
    size = d.shape[1]
    total = np.zeros((size, size), dtype=object)
    for at in range(0, len(d), STRIP):
        some = d[at : at + STRIP]
        for i in range(size):
            pair = some[:, i:] + some[:, i : i + 1]
            pair[:, 0] = some[:, i]
            total[i, i:] += square_sums(pair)
    return total


def covariance(total: np.ndarray, n: int) -> np.ndarray:
    """Of x, from the polarised sums of n * x - sums: 2 cov(a, b) = var(a + b) - var(a) - var(b)."""
    size = len(total)
    out = np.empty((size, size))
    for i in range(size):
        out[i, i] = total[i, i] / n**3
        for j in range(i + 1, size):
            out[i, j] = out[j, i] = (total[i, j] - total[i, i] - total[j, j]) / (2 * n**3)
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, eigenvalues, share of the trace) of up to `most` components, largest first.

    A component whose eigenvalue is rounding noise has NaN as its eigenvalue.
    """
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most].copy(), u[:, ::-1][:, :most]
    trace = float(np.trace(v))
    share = np.maximum(e, 0) / trace if trace > 0 else np.full(len(e), np.nan)
    e[~(e > len(v) * np.finfo(float).eps * max(float(e.max(initial=0)), 0.0))] = np.nan
    return u, e, share


# -- passes over the table ----------------------------------------------------------------------------


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows of a batch, for each size of vector in it."""
    x = batch.column("x")
    sizes, values = x.value_lengths().to_numpy(), x.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield batch.column("vec_id").take(pa.array(own)), values[starts[own][:, None] + np.arange(size)]


def _dimension_sums(clean: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """n and the sum of each dimension, by size of vector: as many numbers as a vector has."""
    rows = (
        clean.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "x"))
        .groupBy("size", "i")
        .agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
        .collect()
    )
    found: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows:
        n, sums = found.setdefault(r["size"], (r["n"], np.zeros(r["size"], dtype=object)))
        sums[r["i"]] = int(r["s"])
    return found


def _polarised_sums(clean: DataFrame, fits: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """`polarised` of the whole table by size: one row per pair of dimensions leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_size(batch):
                own = polarised(deviations(x, *fits[x.shape[1]]))
                totals[x.shape[1]] = totals[x.shape[1]] + own if x.shape[1] in totals else own
        for size, total in totals.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                    pa.array([Decimal(t) for t in total[i, j]], pa.decimal128(38, 0)),
                ],
                names=["size", "i", "j", "total"],
            )

    summed = (
        clean.mapInArrow(run, "size int, i int, j int, total decimal(38,0)")
        .groupBy("size", "i", "j")
        .agg(F.sum("total").alias("total"))
    )
    totals = {size: np.zeros((size, size), dtype=object) for size in fits}
    for r in summed.collect():
        totals[r["size"]][r["i"], r["j"]] = int(r["total"])
    return totals


def whiten(x: np.ndarray, n: int, sums: np.ndarray, directions: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(deviation, whitened) of some rows: the exact sum of squares, and (x - sums / n) on each component."""
    d = deviations(x, n, sums)
    exact = square_sums(d, axis=1) if d.shape[1] else np.zeros(len(d), dtype=object)
    return exact, (d.astype(float) / n) @ directions / np.sqrt(e)


def _identity_errors(clean: DataFrame, models: dict) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened values - identity), by size of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_size(batch):
                n, sums, directions, e, _ = models[x.shape[1]]
                good = ~np.isnan(e)
                w = whiten(x, n, sums, directions[:, good], e[good])[1]
                w = np.hstack([np.ones((len(w), 1)), w])  # row 0: sums
                held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for size, products in held.items():
            i, j = np.triu_indices(len(products))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(i), size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                    pa.array(products[i, j]),
                ],
                names=["size", "i", "j", "product"],
            )

    summed = clean.mapInArrow(run, "size int, i int, j int, product double").groupBy("size", "i", "j").agg(
        F.sum("product").alias("product")
    )
    by_size: dict[int, dict] = {size: {} for size in models}
    for r in summed.collect():
        by_size[r["size"]][r["i"], r["j"]] = r["product"]
    worst = {}
    for size, products in by_size.items():
        n = models[size][0]
        off = [
            abs(p / n - products[0, i] / n * products[0, j] / n - (i == j)) for (i, j), p in products.items() if i
        ]
        worst[size] = max(off, default=0.0)
    return worst


def whitened(
    embeddings: DataFrame,
    most: int = 32,
    scale: float = 64.0,
    shift: int = 1_000_000,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Components c become x = floor(scale * c) + shift. Every dimension, and every sum of two
    dimensions, has its squared values of n * x - (sum of x) added up in exact integers; half the
    difference of variances is their covariance, so no product of two dimensions is ever rounded.
    The components are the eigenvectors of that matrix, the first `most` by falling eigenvalue.
    Tasks give one row per pair of dimensions; only matrices of that size reach the driver.

    Rows whose vector is null, empty or holds a null or non-finite component are left out; every
    other row counts, repeated ones and ones without an id too. Vectors of different sizes are
    whitened apart. A component without variance (fewer distinct rows than dimensions, say) has a
    null `whitened`, and `identity_error` leaves it out; `explained` is null if nothing varies. An
    empty table gives no rows. A deviation beyond a long raises. Other columns are not used.
    """
    clean = settled(integer_vectors(embeddings, scale, shift, id_column, vector_column))
    fits = _dimension_sums(clean)
    totals = _polarised_sums(clean, fits)
    models = {}
    for size, (n, sums) in fits.items():
        directions, e, share = principal(covariance(totals[size], n), most)
        models[size] = (n, sums, directions, e, share)
    errors = _identity_errors(clean, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                for ids, x in _by_size(batch.slice(at, STRIP)):
                    n, sums, directions, e, share = models[x.shape[1]]
                    exact, values = whiten(x, n, sums, directions, e)
                    rows, parts = values.shape
                    each = pa.array(np.repeat(np.arange(rows), parts))
                    tiled = lambda a: pa.array(np.tile(a, rows), from_pandas=True)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(each), tiled(np.arange(1, parts + 1, dtype=np.int32)),
                            pa.array(np.full(rows * parts, n)), pa.array(list(exact), pa.int64()).take(each),
                            pa.array(values.ravel(), from_pandas=True), tiled(share),
                            pa.array(np.full(rows * parts, errors[x.shape[1]])),
                        ],
                        names=[c.split()[0] for c in RESULT.split(", ")],
                    )

    return clean.mapInArrow(run, RESULT)
