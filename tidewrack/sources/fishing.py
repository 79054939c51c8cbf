"""Fishing-effort reports: arbitrarily nested JSON whose leaves are grid cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidewrack.constants import GFW_FISHING
from tidewrack.functions.timeline import utc_instant

#: Fields of a cell, as the reports spell them (fixed values).
FIELDS = ("mmsi", "date", "lat", "lon", "shipName", "flag", "geartype", "vesselType", "hours")


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def nested_cells(text: str | None) -> Iterator[dict]:
    """Every object with a `lat`, however deep, in the order of the text; numbers stay text.

    The open containers stand on a work list, so depth costs no recursion here, and a shallow text
    is done as soon as its own containers are.
    """
    if text is None:
        return
    root = json.loads(text, parse_int=str, parse_float=str, parse_constant=_no_number)
    waiting = [iter((root,))]
    while waiting:
        for node in waiting[-1]:
            if isinstance(node, dict):
                if "lat" in node:
                    yield node
                    continue
                waiting.append(iter(node.values()))
                break
            if isinstance(node, list):
                waiting.append(iter(node))
                break
        else:
            waiting.pop()


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def parse_fishing_effort(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Every object holding a `lat` is a cell; keeps those with vessel, position and time.

    `cell` numbers the cells inside their payload in document order. A payload is searched as deep
    as it goes, on streams and batches alike: built-in functions reach a fixed depth only and order
    the keys of an object. A null payload has no cells; a text that is not JSON is an error.
    """
    keep = [c for c in payloads.columns if c != text]
    found = StructType(
        [*(payloads.schema[c] for c in keep), StructField("cell", IntegerType()), *(StructField(f"_{f}", StringType()) for f in FIELDS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, values = [], [], [[] for _ in FIELDS]
            for row, payload in enumerate(batch.column("_text").to_pylist()):
                for number, cell in enumerate(nested_cells(payload)):
                    rows.append(row)
                    numbers.append(number)
                    for column, name in zip(values, FIELDS, strict=True):
                        column.append(_scalar(cell.get(name)))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(take) for i in range(len(keep))), pa.array(numbers, pa.int32()),
                    *(pa.array(v, pa.string()) for v in values),
                ],
                names=[f.name for f in found],
            )

    cells = payloads.select(*keep, F.col(text).alias("_text")).mapInArrow(run, found)
    label = lambda name: F.nullif(F.col(f"_{name}"), F.lit(""))
    number = lambda name: F.col(f"_{name}").try_cast("double")
    return cells.select(
        *keep,
        "cell",
        label("mmsi").alias("mmsi"),
        utc_instant(F.col("_date")).alias("recorded_at"),
        number("lat").alias("lat"),
        number("lon").alias("lon"),
        F.lit(GFW_FISHING).alias("source"),
        label("shipName").alias("ship_name"),
        label("flag").alias("flag"),
        label("geartype").alias("gear_type"),
        label("vesselType").alias("vessel_type"),
        number("hours").alias("effort_hours"),
    ).dropna(subset=["mmsi", "recorded_at", "lat", "lon"])


def read_fishing_effort(spark: SparkSession, path: str) -> DataFrame:
    """Cells of landed reports, one payload per line, with their order as `ordinal`."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = parse_fishing_effort(lines)
    return parsed.withColumn("ordinal", F.struct("line", "cell")).drop("line", "cell")
