"""Keyed merges: last-wins batches, upserts, guarded writes, replacements, precedence.

Every "one row per key" step is a grouped `max_by`, so a key that holds a large share of
the rows is reduced on the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.constants import MEASURES, WIND_MEASURES


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest `order` per key (order columns must make it unique)."""
    rest = [name for name in df.columns if name not in keys]
    ranking = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranking).alias("_kept"))
    return picked.select(*keys, "_kept.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the least `order` per key."""
    rest = [name for name in df.columns if name not in keys]
    ranking = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranking).alias("_kept"))
    return picked.select(*keys, "_kept.*").select(*df.columns)


def merge_upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    overwrite: bool,
    only: Sequence[str] | None = None,
    where: str | None = None,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Insert new keys; on conflict keep the row, or set `only` where `where` holds on it.

    Of updates that repeat a key the last in `order` counts (without overwriting, the first);
    where no order is given, rows are ordered by their other columns. Columns that `updates`
    lacks are null for inserted rows. `where` is an SQL predicate over the existing row.
    """
    if not overwrite:
        return insert_if_absent(target, updates, keys, order)
    updates = last_per_key(updates, keys, order or _other_columns(updates, keys))
    settable = set(only if only is not None else updates.columns) - set(keys)
    old = target.withColumn("_stored", F.lit(True))
    if where is not None:
        old = old.withColumn("_open", F.expr(where))
    old = old.withColumnsRenamed({c: f"_old_{c}" for c in target.columns if c not in keys})
    new = updates.withColumn("_given", F.lit(True)).withColumnsRenamed(
        {c: f"_new_{c}" for c in updates.columns if c not in keys}
    )
    joined = old.join(new, list(keys), "full_outer")
    inserted = F.col("_stored").isNull()
    replaced = F.col("_given").isNotNull() & F.col("_stored").isNotNull()
    if where is not None:
        replaced = replaced & F.coalesce(F.col("_open"), F.lit(False))

    def resolved(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in updates.columns:
            return F.col(f"_old_{name}").alias(name)
        takes_new = inserted | replaced if name in settable else inserted
        return F.when(takes_new, F.col(f"_new_{name}")).otherwise(F.col(f"_old_{name}")).alias(name)

    return joined.select(*(resolved(name) for name in target.columns))


def _other_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys] or [keys[0]]


def insert_if_absent(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """First write wins: rows whose key is already stored are dropped, as are later rows of a key."""
    rows = first_per_key(rows, keys, order or _other_columns(rows, keys))
    fresh = rows.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def replace_scope(target: DataFrame, rows: DataFrame, scope: Column) -> DataFrame:
    """Drop the stored rows in `scope` (a null scope keeps the row), then add `rows`."""
    return target.filter(~F.coalesce(scope, F.lit(False))).unionByName(rows)


def forecast_guarded_write(
    condition: DataFrame, rows: DataFrame, measures: Sequence[str], live: bool
) -> DataFrame:
    """Write one product's measures; a live write only touches rows still marked forecast."""
    keys = ["valid_at", "lat", "lon"]
    stamped = rows.select(*keys, *measures).withColumn("forecast", F.lit(live))
    return merge_upsert(
        condition,
        stamped,
        keys,
        overwrite=True,
        only=[*measures, "forecast"],
        where="forecast" if live else None,
    )


def merge_by_precedence(raw: DataFrame) -> DataFrame:
    """Several source rows per cell-hour to one: archived value first, forecast second."""

    def merged(name: str) -> Column:
        product = "weather" if name in WIND_MEASURES else "marine"
        archived = F.max(F.when(F.col("source") == f"{product}_archive", F.col(name)))
        forecast = F.max(F.when(F.col("source") == f"{product}_forecast", F.col(name)))
        return F.coalesce(archived, forecast).alias(name)

    all_forecast = F.bool_and(F.col("source").isin("weather_forecast", "marine_forecast"))
    return raw.groupBy("valid_at", "lat", "lon").agg(
        all_forecast.alias("forecast"), *(merged(name) for name in MEASURES)
    )


def keep_newest(drift: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: newest model version, then newest id, then the larger value."""
    return last_per_key(drift, keys, ["model_version", "id", "drift_index"])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.join(parents, child_key, "left_anti")


def reconcile(
    pairs: dict[str, tuple[DataFrame, DataFrame]], keys: dict[str, Sequence[str]]
) -> DataFrame:
    """Per table: distinct keys before, rows after, and whether they agree."""
    report: DataFrame | None = None
    for name, (before, after) in pairs.items():
        counted = (
            before.select(*keys[name])
            .distinct()
            .agg(F.count("*").alias("n"))
            .select(F.lit(0).alias("side"), "n")
            .unionAll(after.agg(F.count("*").alias("n")).select(F.lit(1).alias("side"), "n"))
        )
        line = counted.agg(
            F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("keys_before"),
            F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("rows_after"),
        ).select(F.lit(name).alias("table_name"), "keys_before", "rows_after")
        report = line if report is None else report.unionAll(line)
    assert report is not None
    return report.withColumn(
        "kept", F.when(F.col("keys_before") == F.col("rows_after"), "yes").otherwise("no")
    )
