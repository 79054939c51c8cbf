"""The regular forcing lattice: cells, gap filling, standardising, bilinear sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.constants import (
    COAST_LIMIT_KM,
    DRIFT_HOURS,
    GRID_COLUMNS,
    GRID_ROWS,
    GRID_STEP_DEG,
    LAND_MARGIN_KM,
    REGION,
    Box,
)
from tidewrack.functions.geodesy import grid_cell, polar_to_uv
from tidewrack.functions.scoring import clamp

CELLS = GRID_ROWS * GRID_COLUMNS


def grid(spark: SparkSession, box: Box = REGION, step_deg: float = GRID_STEP_DEG) -> DataFrame:
    """Every cell of the lattice over `box`: (lat, lon), rounded to 4 decimals."""
    rows = round((box.max_lat - box.min_lat) / step_deg) + 1
    columns = round((box.max_lon - box.min_lon) / step_deg) + 1
    cell = spark.range(rows * columns)
    row = F.floor(F.col("id") / columns).cast("double")
    column = (F.col("id") % columns).cast("double")
    return cell.select(
        grid_cell(F.lit(box.min_lat) + row * step_deg).alias("lat"),
        grid_cell(F.lit(box.min_lon) + column * step_deg).alias("lon"),
    )


def select_grid(cells: DataFrame) -> DataFrame:
    """Cells near the shore that are sea, or land close enough to it (unknown height: land)."""
    distance = F.col("distance_km")
    sea = F.coalesce(F.col("elevation_m"), F.lit(0.0)) < 0
    return cells.filter((distance <= COAST_LIMIT_KM) & (sea | (distance <= LAND_MARGIN_KM)))


def lattice_index(df: DataFrame) -> DataFrame:
    """Adds (row_i, col_j) of the nearest lattice cell and drops rows outside the lattice."""
    row = F.rint((F.col("lat") - REGION.min_lat) / GRID_STEP_DEG).cast("int")
    column = F.rint((F.col("lon") - REGION.min_lon) / GRID_STEP_DEG).cast("int")
    return (
        df.withColumn("row_i", row)
        .withColumn("col_j", column)
        .filter(
            F.col("row_i").between(0, GRID_ROWS - 1)
            & F.col("col_j").between(0, GRID_COLUMNS - 1)
        )
    )


def forcing_fields(condition: DataFrame) -> DataFrame:
    """Hourly vector fields on the lattice: currents and wind in m/s, waves in m, tide in m."""
    current_u, current_v = polar_to_uv(
        F.col("current_speed_kmh"), F.col("current_direction_deg"), blows_from=False
    )
    wind_u, wind_v = polar_to_uv(
        F.col("wind_speed_kmh"), F.col("wind_direction_deg"), blows_from=True
    )
    return lattice_index(condition).select(
        "valid_at",
        "row_i",
        "col_j",
        current_u.alias("current_u"),
        current_v.alias("current_v"),
        wind_u.alias("wind_u"),
        wind_v.alias("wind_v"),
        F.coalesce("wave_height_m", F.lit(0.0)).alias("wave_m"),
        "sea_level_m",
    )


#: Planes filled together: bounds what a worker holds, however many an Arrow batch brings.
PLANES_AT_ONCE = 128


def _neighbour_sums(padded: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours of each inner cell of zero-padded planes."""
    return padded[:, :-2, 1:-1] + padded[:, 2:, 1:-1] + padded[:, 1:-1, :-2] + padded[:, 1:-1, 2:]


def _fill_planes(cells: pd.Series, values: pd.Series, passes: int) -> pd.Series:
    """Dense row-major planes from sparse cells, with holes filled; some planes at a time."""
    filled: list[np.ndarray] = []
    for at in range(0, len(cells), PLANES_AT_ONCE):
        some = slice(at, at + PLANES_AT_ONCE)
        flat = np.zeros((len(cells[some]), CELLS))
        for plane, cell, value in zip(flat, cells[some], values[some], strict=True):
            plane[np.asarray(cell, dtype=np.int64)] = np.asarray(value, dtype=np.float64)
        padded = np.pad(flat.reshape(-1, GRID_ROWS, GRID_COLUMNS), ((0, 0), (1, 1), (1, 1)))
        inner = padded[:, 1:-1, 1:-1]
        for _ in range(passes):
            total, known = _neighbour_sums(padded), _neighbour_sums((padded != 0.0).astype(float))
            holes = (inner == 0.0) & (known > 0)
            inner[holes] = total[holes] / known[holes]
        filled.extend(inner.reshape(len(flat), CELLS))
    return pd.Series(filled)


def fill_gaps(
    field: DataFrame, name: str, key: Sequence[str] = ("valid_at",), passes: int = 6
) -> DataFrame:
    """Dense planes per key with holes filled from their neighbours, `passes` times.

    A hole is a value of 0 (or a missing cell) and takes the mean of its non-zero neighbours.
    A group is the known cells of one plane, at most the lattice, so all passes run on it
    after one shuffle; the stencil works on Arrow batches of whole planes.
    """
    cell = F.col("row_i") * GRID_COLUMNS + F.col("col_j")
    one_per_cell = field.groupBy(*key, cell.alias("cell")).agg(F.max(name).alias("value"))
    fill = F.pandas_udf(
        lambda cells, values: _fill_planes(cells, values, passes), "array<double>"
    )
    planes = (
        one_per_cell.withColumn("value", F.coalesce("value", F.lit(0.0)))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("cell", "value")).alias("known"))
        .select(*key, fill(F.col("known.cell"), F.col("known.value")).alias("plane"))
    )
    return planes.select(*key, F.posexplode("plane").alias("cell", name)).select(
        *key,
        F.floor(F.col("cell") / GRID_COLUMNS).cast("int").alias("row_i"),
        (F.col("cell") % GRID_COLUMNS).alias("col_j"),
        name,
    )


def standardise(field: DataFrame, name: str) -> DataFrame:
    """Per cell z-score over time, flat cells undivided, clipped to +-2, unknown as 0."""
    stats = field.groupBy("row_i", "col_j").agg(
        F.avg(name).alias("_mean"), F.stddev_pop(name).alias("_std")
    )
    spread = F.when(F.col("_std") > 1e-6, F.col("_std")).otherwise(F.lit(1.0))
    z = (F.col(name) - F.col("_mean")) / spread
    # Statistics are bounded by the lattice: one row per cell.
    return (
        field.join(F.broadcast(stats), ["row_i", "col_j"])
        .withColumn(name, F.coalesce(clamp(z, -2.0, 2.0), F.lit(0.0)))
        .drop("_mean", "_std")
    )


def sample_field(points: DataFrame, field: DataFrame, names: Sequence[str]) -> DataFrame:
    """`points` with the bilinear values of `names` at their (valid_at, lat, lon).

    Positions clamp to the lattice; a corner missing from the field counts as 0. Each field
    row is first handed to the four squares it is a corner of, so points, the large side,
    are joined once, to one row that has all four corners, and are not grouped again.
    """
    row = (F.col("lat") - REGION.min_lat) / GRID_STEP_DEG
    column = (F.col("lon") - REGION.min_lon) / GRID_STEP_DEG
    based = (
        points.withColumn("_r0", clamp(F.floor(row), 0, GRID_ROWS - 2).cast("int"))
        .withColumn("_c0", clamp(F.floor(column), 0, GRID_COLUMNS - 2).cast("int"))
        .withColumn("_fr", clamp(row - F.col("_r0"), 0.0, 1.0))
        .withColumn("_fc", clamp(column - F.col("_c0"), 0.0, 1.0))
    )
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    offered = field.select(
        "valid_at",
        "row_i",
        "col_j",
        *names,
        F.explode(F.array(*(F.lit(n) for n in range(4)))).alias("_corner"),
    )
    squares = offered.groupBy(
        "valid_at",
        (F.col("row_i") - F.floor(F.col("_corner") / 2).cast("int")).alias("_r0"),
        (F.col("col_j") - F.col("_corner") % 2).alias("_c0"),
    ).agg(
        *(
            F.max(F.when(F.col("_corner") == n, F.col(name))).alias(f"_{name}_{n}")
            for name in names
            for n in range(4)
        )
    )

    def blended(name: str) -> Column:
        total = F.lit(0.0)
        for n, (down, right) in enumerate(corners):
            share = (F.col("_fr") if down else 1 - F.col("_fr")) * (
                F.col("_fc") if right else 1 - F.col("_fc")
            )
            total = total + share * F.coalesce(F.col(f"_{name}_{n}"), F.lit(0.0))
        return total.alias(name)

    joined = based.join(squares, ["valid_at", "_r0", "_c0"], "left")
    return joined.select(*points.columns, *(blended(name) for name in names))


def coverage_extent(condition: DataFrame, days: DataFrame, hours: int = DRIFT_HOURS) -> DataFrame:
    """Per release day: contiguous hours of forcing from its midnight, all and archived only.

    `days` has one column release_day. Hours present are distinct before the join, so the
    work grows with the calendar, not with the cell-hours.
    """
    present = condition.groupBy("valid_at").agg(F.bool_or(~F.col("forecast")).alias("archived"))
    # extended by the archive: every hour of every window, at most `hours` per release day
    wanted = days.select(
        "release_day", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour")
    ).withColumn(
        "valid_at",
        F.expr("timestampadd(HOUR, hour, cast(release_day as timestamp_ntz))"),
    )
    joined = wanted.join(
        present.withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz")), "valid_at", "left"
    )
    first_gap = F.min(F.when(F.col("archived").isNull(), F.col("hour")))
    first_unsettled = F.min(F.when(~F.coalesce("archived", F.lit(False)), F.col("hour")))
    return joined.groupBy("release_day").agg(
        F.coalesce(first_gap, F.lit(hours)).alias("hours"),
        F.coalesce(first_unsettled, F.lit(hours)).alias("archived_hours"),
        F.when(first_unsettled.isNull(), "yes").otherwise("no").alias("settled"),
    )
