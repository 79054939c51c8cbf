"""Exact global order statistics without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import range_partitions, settled

# Rows of a partition are numbered in the low bits, partitions in the high ones.
ROW_BITS = 33
LEVEL_BUCKETS = 1 << 21
# 1024 times the exponents of the smallest and of the largest double, and some.
BEYOND_SMALLEST, BEYOND_LARGEST = 1100 * 1024, 2200 * 1024


def ordinal_rank(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1-based rank by `order`, which must be a unique key so that equal scores also split.

    A range shuffle spreads rows evenly, each partition sorts itself, and the sizes of the
    partitions before it (one number per partition) shift its local positions.
    """
    parts = range_partitions(df.sparkSession)
    placed = settled(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    local = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_part", "_place", "_before")
    )


def _locate(counted: DataFrame, path: Sequence[str], step: str) -> DataFrame:
    """Of counted buckets under each `path`, those that hold a wanted 0-based position."""
    running = Window.partitionBy(*path).orderBy(step) if path else Window.orderBy(step)
    end = F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        counted.withColumn("_end", end)
        .withColumn("_start", F.col("_end") - F.col("n"))
        .withColumn(
            "wanted",
            F.expr("filter(wanted, w -> w.position >= _start AND w.position < _end)"),
        )
        .filter(F.size("wanted") > 0)
        .withColumn(
            "wanted",
            F.expr(
                "transform(wanted, w -> named_struct('q', w.q, 'side', w.side,"
                " 'position', w.position - _start, 'share', w.share))"
            ),
        )
        .drop("n", "_start", "_end")
    )


def coarse_bucket(v: Column) -> Column:
    """A whole number that never falls as `v` grows, for any double: 1024 buckets per power of two.

    Negative numbers mirror positive ones; infinities and NaN (the largest) have buckets of their own.
    """
    size = F.abs(v)
    of_size = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0)) * 1024) + BEYOND_SMALLEST
    bucket = F.when(size == float("inf"), 2 * BEYOND_LARGEST).when(v == 0, 0).otherwise(of_size)
    return F.when(F.isnan(v), 3 * BEYOND_LARGEST).otherwise(F.signum(v).cast("long") * bucket)


def fine_bucket(v: Column, low: Column, high: Column) -> Column:
    """Where `v` lies between the ends of its bucket, in LEVEL_BUCKETS parts; never falls as `v` grows."""
    return F.when(low < high, F.floor((v - low) / (high - low) * LEVEL_BUCKETS)).otherwise(0)


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of a column of any doubles: rows (q, value); exact, nulls ignored.

    Three counting passes whatever the values: by sign and power of two, then a million-fold inside
    the buckets that hold a wanted place (which span less than a thousandth of their size), then by
    the values themselves, of which no more than two million can be left. Each pass is a map-side
    combined count, and at most 2 buckets per quantile go on to the next one.
    """
    v = F.col(value).cast("double")
    known = df.select(v.alias("v")).filter(v.isNotNull()).withColumn("b1", coarse_bucket(F.col("v")))
    total = known.agg(F.count("*").alias("n")).scalar()
    places = []
    for q in quantiles:
        at = F.lit(float(q)) * (F.col("_total") - 1)
        for side, position in ((0, F.floor(at)), (1, F.ceil(at))):
            places.append(
                F.struct(
                    F.lit(float(q)).alias("q"),
                    F.lit(side).alias("side"),
                    position.cast("long").alias("position"),
                    (at - F.floor(at)).alias("share"),
                )
            )
    first = _locate(
        known.groupBy("b1")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("_total", total)
        .withColumn("wanted", F.array(*places))
        .drop("_total"),
        [],
        "b1",
    )
    # At most two buckets per quantile are left on this side.
    inside = known.join(F.broadcast(first), "b1").withColumn("b2", fine_bucket(F.col("v"), F.col("low"), F.col("high")))
    second = _locate(
        inside.groupBy("b1", "b2").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")),
        ["b1"],
        "b2",
    )
    third = _locate(
        inside.drop("wanted").join(F.broadcast(second), ["b1", "b2"])
        .groupBy("b1", "b2", "v")
        .agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")),
        ["b1", "b2"],
        "v",
    )
    sides = third.select("v", F.inline("wanted"))
    low = F.max(F.when(F.col("side") == 0, F.col("v")))
    high = F.max(F.when(F.col("side") == 1, F.col("v")))
    share = F.max("share")
    # Weighted, so that no difference of two large values overflows.
    return sides.groupBy("q").agg(
        F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias("value")
    )


def misses_below_hits(df: DataFrame, score: str, hit: Column, ties: Sequence[str]) -> DataFrame:
    """One row (rows, hits, below): below is the number of misses under each hit, summed over the hits.

    Rows are ordered by `score`, then by the columns `ties`, which make them unique. Nothing is
    sorted as a whole: buckets of scores are counted, misses in lower buckets are taken as counted,
    and only buckets with both hits and misses are looked into, in finer buckets, then by score, then
    by each column of `ties`. Null scores do not count.
    """
    rows = settled(
        df.select(F.col(score).cast("double").alias("_v"), hit.alias("_hit"), *ties)
        .where("_v IS NOT NULL")
        .withColumn("_b1", coarse_bucket(F.col("_v")))
    )
    hits = F.count_if("_hit").alias("_hits")
    counted, path, total = [], [], None
    for key in ("_b1", "_b2", "_v", *ties):
        own = rows.groupBy(*path, key).agg(
            F.count("*").alias("_n"), hits, F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        own = settled(own)
        before = Window.partitionBy(*path).orderBy(key) if path else Window.orderBy(key)
        running = before.rowsBetween(Window.unboundedPreceding, -1)
        misses = F.coalesce(F.sum(F.col("_n") - F.col("_hits")).over(running), F.lit(0))
        counted.append(own.where("_hits > 0 OR _hits < _n").withColumn("_under", misses * F.col("_hits")).agg(F.sum("_under").alias("below")))
        if total is None:
            total = own.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_hits"), F.lit(0)).alias("hits"))
        path.append(key)
        mixed = own.where("_hits > 0 AND _hits < _n")
        if key == ties[-1] or mixed.isEmpty():
            break
        # At most one bucket per hit is left on this side.
        rows = rows.join(mixed.select(*path, "_low", "_high"), path)
        if key == "_b1":
            rows = rows.withColumn("_b2", fine_bucket(F.col("_v"), F.col("_low"), F.col("_high")))
        rows = settled(rows.drop("_low", "_high"))
    below = counted[0]
    for part in counted[1:]:
        below = below.unionByName(part)
    return total.withColumn("below", F.lit(below.agg(F.coalesce(F.sum("below"), F.lit(0)).alias("below")).scalar()))


def ordinal_in_group(
    df: DataFrame, key: Sequence[str], chunk: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """0-based occurrence number within a key, in (chunk, order) order.

    `chunk` splits the input into bounded runs that follow each other (file splits, id
    ranges). Rows are numbered within (key, chunk) and shifted by the counts of earlier
    chunks, so even a key that holds most rows is numbered in parallel.
    """
    matched = [*key, *chunk]
    inside = Window.partitionBy(*matched).orderBy(*order)
    before = Window.partitionBy(*key).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*matched)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = df.withColumn("_row", F.row_number().over(inside) - 1)
    same = None
    shifts = offsets.select(*(F.col(c).alias(f"_k_{c}") for c in matched), "_before")
    for c in matched:
        match = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        same = match if same is None else same & match
    return numbered.join(shifts, same).withColumn(
        name, (F.col("_row") + F.col("_before")).cast("long")
    ).drop("_row", "_before", *(f"_k_{c}" for c in matched))


def smallest_by_hash(df: DataFrame, hash_hex: Column, keep: Column) -> DataFrame:
    """Exactly `keep` rows (a scalar column) with the smallest hex hashes, hashes unique.

    Counting 5 leading hex digits finds the one bucket the cut falls in; only that bucket
    (a millionth of the rows) is ordered row by row.
    """
    hashed = df.withColumn("_hash", hash_hex).withColumn("_bucket", F.substring("_hash", 1, 5))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(running))
        .withColumn("_keep", keep)
        .select(
            "_bucket",
            F.greatest(
                F.least(F.col("_n"), F.col("_keep") - (F.col("_end") - F.col("_n"))), F.lit(0)
            ).alias("_quota"),
            "_n",
        )
        .filter(F.col("_quota") > 0)
    )
    # One row per leading-digits bucket: at most 16^5.
    marked = hashed.join(F.broadcast(buckets), "_bucket")
    whole = marked.filter(F.col("_quota") == F.col("_n"))
    cut = (
        marked.filter(F.col("_quota") < F.col("_n"))
        .withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash")))
        .filter(F.col("_row") <= F.col("_quota"))
        .drop("_row")
    )
    return whole.unionByName(cut).drop("_hash", "_bucket", "_quota", "_n")
