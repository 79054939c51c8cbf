"""Cutting and densifying lines that are longer than a task: tables of points, in blocks.

`points(line_id, seq, lat, lon)` has one row per point; `seq` orders the points of a line and need
not be dense. A line is dealt into blocks of a bounded number of points, and every step works on blocks:
leg lengths become running sums over the whole line, the point at which a piece that starts anywhere
closes is found by a search in those sums, and the cuts are followed from block to block by doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.constants import DENSIFY_KM, REGION, SEGMENT_LENGTH_KM
from tidewrack.functions.geodesy import bearing_deg, haversine_km, in_box
from tidewrack.functions.labels import coordinate_text, identity_hash
from tidewrack.session import settled

BLOCK_POINTS = 65_536
NODE = ["line_id", "block", "entry"]


def points_of(lines: DataFrame) -> DataFrame:
    """Lines with an array of points as a table of points."""
    return lines.select("line_id", F.posexplode("points").alias("seq", "p")).select(
        "line_id", F.col("seq").cast("long").alias("seq"), "p.lat", "p.lon"
    )


def legs(points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """`points` with their block, the point before (null for the first of a line) and the leg from it.

    A span is `block_points` of `seq`, and the point before its first is the last of the span before,
    one row per span. Spans that follow each other make one block as long as fewer than `block_points`
    points begin it: a block has less than twice as many points, and few blocks are nearly empty.
    """
    blocked = points.select(
        F.col("line_id").cast("long").alias("line_id"), F.col("seq").cast("long").alias("seq"), "lat", "lon",
        F.floor(F.col("seq") / block_points).alias("span"),
    )
    # Plain numbers, so that the points are hashed where they are read and not sorted there.
    ends = blocked.groupBy("line_id", "span").agg(
        F.max_by("lat", "seq").alias("last_lat"), F.max_by("lon", "seq").alias("last_lon"), F.count("*").alias("n")
    )
    before = Window.partitionBy("line_id").orderBy("span")
    ahead = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.struct(F.col("last_lat").alias("lat"), F.col("last_lon").alias("lon"))
    borrowed = ends.select(
        "line_id", "span", F.lag(last).over(before).alias("borrowed"), F.floor(ahead / block_points).alias("block")
    )
    inside = Window.partitionBy("line_id", "span").orderBy("seq")
    placed = blocked.join(borrowed, ["line_id", "span"]).withColumn(
        "from", F.coalesce(F.lag(F.struct("lat", "lon")).over(inside), F.col("borrowed"))
    ).drop("span")
    km = F.when(F.col("from").isNull(), 0.0).otherwise(haversine_km(F.col("from.lat"), F.col("from.lon"), F.col("lat"), F.col("lon")))
    return placed.drop("borrowed").withColumn("km", km)


def _along(measured: DataFrame) -> DataFrame:
    """`measured` with `d`, the length of the line up to each point."""
    inside = Window.partitionBy("line_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = measured.withColumn("run", F.sum("km").over(inside))
    totals = run.groupBy("line_id", "block").agg(F.max("run").alias("total"))
    earlier = Window.partitionBy("line_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("line_id", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("offset"))
    return run.join(offsets, ["line_id", "block"]).withColumn("d", F.col("offset") + F.col("run")).drop("run", "offset")


def _last_cut(d: np.ndarray, length_km: float) -> tuple[np.ndarray, np.ndarray]:
    """(where the piece that starts at each point closes, or the number of points; the last cut of the
    block that is reached from each point)."""
    close = np.searchsorted(d, d + length_km, side="left")
    reached = np.where(close < len(d), close, np.arange(len(d)))
    while True:
        further = reached[reached]
        if (further == reached).all():
            return close, reached
        reached = further


def _entries(measured: DataFrame, length_km: float) -> DataFrame:
    """(line_id, block, entry): the first cut in every block that has one.

    Only points within a piece's length of the end of the block before can be first. Each of them
    leads to one such point of a later block (a few rows per block); which are on the way from the
    start of the line is found by doubling the steps.
    """
    blocks = settled(measured.groupBy("line_id", "block").agg(F.max("d").alias("upto")))
    earlier = Window.partitionBy("line_id").orderBy("block")
    bounds = blocks.withColumn("before", F.lag("upto").over(earlier))
    later = blocks.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("block", "upto"))).alias("blocks"))

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        d, before = frame["d"].to_numpy(), frame["before"].iloc[0]
        _, reached = _last_cut(d, length_km)
        # Of the first block of a line only its first point is an entry.
        many = 1 if np.isnan(before) else int(np.searchsorted(d, before + length_km, side="left")) + 1
        out = frame.iloc[:many]
        return pd.DataFrame({
            "line_id": out["line_id"], "block": out["block"], "entry": out["seq"], "d": out["d"],
            "target": d[reached[: len(out)]] + length_km, "first": np.isnan(before),
        })

    nodes = settled(
        measured.select("line_id", "block", "seq", "d").join(bounds.drop("upto"), ["line_id", "block"])
        .groupBy("line_id", "block")
        .applyInPandas(candidates, "line_id long, block long, entry long, d double, target double, first boolean")
    )
    # A target lies in the first later block that reaches it.
    ahead = F.filter("blocks", lambda b: (b["block"] > F.col("block")) & (b["upto"] >= F.col("target")))
    asking = settled(nodes.join(later, "line_id").select(
        *(F.col(c).alias(f"from_{c}") for c in ("block", "entry")), "line_id", "target",
        F.get(ahead, F.lit(0))["block"].alias("block"),
    ).where("block IS NOT NULL"))

    def land(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("entry")
        if not len(asked):
            return pd.DataFrame({"line_id": [], "block": [], "entry": [], "to_block": [], "to_entry": []}, dtype="int64")
        at = np.searchsorted(there["d"].to_numpy(), asked["target"].to_numpy(), side="left")
        return pd.DataFrame({
            "line_id": asked["line_id"], "block": asked["from_block"], "entry": asked["from_entry"],
            "to_block": asked["block"], "to_entry": there["entry"].to_numpy()[np.minimum(at, len(there) - 1)],
        })

    keys = ["line_id", "block"]
    steps = settled(
        asking.groupBy(*keys).cogroup(nodes.groupBy(*keys))
        .applyInPandas(land, "line_id long, block long, entry long, to_block long, to_entry long")
    )
    reached = settled(nodes.where("first").select(*NODE))
    while not steps.isEmpty():
        gone = reached.join(steps, NODE).select("line_id", F.col("to_block").alias("block"), F.col("to_entry").alias("entry"))
        reached = settled(reached.unionByName(gone).distinct())
        second = steps.withColumnsRenamed({"block": "b0", "entry": "e0", "to_block": "block", "to_entry": "entry"})
        steps = settled(
            second.join(steps, NODE).select("line_id", F.col("b0").alias("block"), F.col("e0").alias("entry"), "to_block", "to_entry")
        )
    return reached


def cuts(measured: DataFrame, length_km: float) -> DataFrame:
    """(line_id, block, seq) of every point at which a piece starts, as the greedy walk has them."""

    def walk(points: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("seq")
        close, _ = _last_cut(points["d"].to_numpy(), length_km)
        seq, found = points["seq"].to_numpy(), []
        if len(entry):
            at = int(np.searchsorted(seq, entry["entry"].iloc[0]))
            while at < len(seq):
                found.append(at)
                at = int(close[at])
        return points.iloc[found][["line_id", "block", "seq"]]

    keys = ["line_id", "block"]
    rows = measured.select(*keys, "seq", "d").groupBy(*keys)
    return rows.cogroup(_entries(measured, length_km).groupBy(*keys)).applyInPandas(walk, "line_id long, block long, seq long")


def segment_points(points: DataFrame, length_km: float = SEGMENT_LENGTH_KM, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Pieces of at least `length_km` of lines of any length: the rows of `shoreline.segment_lines`,
    with the `seq` a piece starts at.

    A piece closes at the first point where the running length of the line has grown by `length_km`
    since its start; where that is a matter of the last bits, a walk that adds up its own legs may
    decide otherwise. A piece has to fit in a task, a line has not.
    """
    measured = settled(_along(legs(points, block_points)))
    found = settled(cuts(measured, length_km))
    at = found.withColumn("cut", F.col("seq"))
    earlier = Window.partitionBy("line_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = measured.select("line_id", "block").distinct().join(
        found.groupBy("line_id", "block").agg(F.max("seq").alias("last")), ["line_id", "block"], "left"
    )
    carried = held.select("line_id", "block", F.max("last").over(earlier).alias("carried"))
    upto = Window.partitionBy("line_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = measured.join(at, ["line_id", "block", "seq"], "left").join(carried, ["line_id", "block"])
    before = F.coalesce(F.max("cut").over(upto), F.col("carried"))
    # A cut ends the piece before it and starts its own; other points are in the piece before them.
    members = marked.withColumn("starts", F.array_compact(F.array(before, F.col("cut")))).select(
        "line_id", F.explode("starts").alias("start"),
        F.struct("seq", "lat", "lon", "km", F.col("cut").isNotNull().alias("cut")).alias("p"),
    )
    runs = members.groupBy("line_id", "start").agg(F.sort_array(F.collect_list("p")).alias("run"))
    first, last = F.element_at("run", 1), F.element_at("run", -1)
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda a, x: a + x)
    length = total(F.transform(F.slice("run", F.lit(2), F.size("run")), lambda p: p["km"]))
    mean = lambda axis: total(F.transform("run", lambda p: p[axis])) / F.size("run")
    payload = F.concat(
        coordinate_text(first["lon"]), F.lit(","), coordinate_text(first["lat"]), F.lit("|"),
        coordinate_text(last["lon"]), F.lit(","), coordinate_text(last["lat"]),
    )
    return (
        runs.where(F.size("run") > 1)
        .withColumn("length_km", length)
        .where(last["cut"] | (F.col("length_km") >= length_km / 2))
        .select(
            "line_id",
            "start",
            identity_hash(payload).alias("external_id"),
            mean("lat").alias("center_lat"),
            mean("lon").alias("center_lon"),
            "length_km",
            bearing_deg(first["lat"], first["lon"], last["lat"], last["lon"]).alias("orientation_deg"),
            F.transform("run", lambda p: F.struct(F.round(p["lon"], 5).alias("lon"), F.round(p["lat"], 5).alias("lat"))).alias("path"),
        )
        .where(in_box(F.col("center_lat"), F.col("center_lon"), REGION))
    )


def densify_points(points: DataFrame, spacing_km: float = DENSIFY_KM, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(line_id, seq, step, lat, lon): the points and one every `spacing_km` along the leg to each.

    The point itself is the last step of its leg; the first point of a line is step 1 of no leg.
    """
    steps = F.floor(F.col("km") / spacing_km).cast("int")
    stepped = legs(points, block_points).withColumn("steps", steps).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.col("steps") + 1))
    )
    share = F.col("step") * spacing_km / F.col("km")

    def along(axis: str) -> Column:
        start, end = F.col(f"from.{axis}"), F.col(axis)
        return F.when(F.col("step") > F.col("steps"), end).otherwise(start + (end - start) * share)

    return stepped.select("line_id", "seq", "step", along("lat").alias("lat"), along("lon").alias("lon"))
