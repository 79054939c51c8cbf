"""Domain tables derived from the generic test tables (see FIXTURES.md)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.merging import keep_newest, merge_by_precedence
from tidewrack.session import spread

LINE_POINTS = 40


# Given, so that reading a table starts no job to look at file footers.
SCHEMAS = {
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
        " props string"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def _center_lat(key: str) -> Column:
    return F.expr(f"42e0 + ({key} * 7919 % 9500) / 1000e0")


def _center_lon(key: str) -> Column:
    return F.expr(f"-6e0 + ({key} * 104729 % 15500) / 1000e0")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("segment_id"),
        _center_lat("s_suppkey").alias("center_lat"),
        _center_lon("s_suppkey").alias("center_lon"),
        F.expr("8e0 + s_suppkey % 5").alias("length_km"),
        F.expr("cast(s_suppkey * 37 % 360 as double)").alias("orientation_deg"),
    )


def segment_points(spark: SparkSession, folder: str) -> DataFrame:
    return segments(spark, folder).select(
        "segment_id",
        F.posexplode(
            F.expr(
                "transform(sequence(0, 4), k -> named_struct("
                "'lat', center_lat + (k - 2) * 0.02e0, 'lon', center_lon + (k - 2) * 0.01e0))"
            )
        ).alias("seq", "p"),
    ).select("segment_id", "seq", "p.lat", "p.lon")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One open line of LINE_POINTS points per customer: (line_id, points).

    A customer is a few bytes, its line is not: they are dealt out before the lines are made.
    """
    return spread(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(
        F.col("c_custkey").alias("line_id"),
        F.expr(
            f"transform(sequence(0, {LINE_POINTS - 1}), k -> named_struct("
            "'lat', 42e0 + c_nationkey * 0.35e0 + ((c_custkey + k * k) % 7) * 0.005e0,"
            "'lon', -5.997e0 + (c_custkey * 13 % 310) * 0.05e0 + k * 0.03e0))"
        ).alias("points"),
    )


def strandings(spark: SparkSession, folder: str) -> DataFrame:
    # The segment of an order is its customer key folded onto the dense segment keys, so
    # the centre is a formula of that key and needs no join.
    count = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    return (
        table(spark, folder, "orders")
        .withColumn("_seg", F.col("o_custkey") % count)
        .select(
            F.col("o_orderkey").cast("string").alias("external_id"),
            F.when(F.col("o_orderstatus") == "F", "gbif")
            .otherwise("pelagis_histocarto")
            .alias("source"),
            F.col("o_orderdate").alias("recorded_at"),
            (_center_lat("_seg") + F.expr("(o_orderkey % 401 - 200) / 1000e0")).alias("lat"),
            (_center_lon("_seg") + F.expr("(o_orderkey % 343 - 171) / 1000e0")).alias("lon"),
            F.expr("cast(1 + o_orderkey % 3 as int)").alias("individual_count"),
        )
    )


GEAR_OF_EVENT = {"click": "trawlers", "purchase": "Set_Gillnets", "signup": "seiners"}


def vessels(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    gear = F.when(kind == "view", F.lit(None).cast("string"))
    for name, label in GEAR_OF_EVENT.items():
        gear = gear.when(kind == name, F.lit(label))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("mmsi"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("recorded_at"),
        F.expr("42e0 + (event_id * 7919 % 9500) / 1000e0").alias("lat"),
        F.expr("-6e0 + (event_id * 104729 % 15500) / 1000e0").alias("lon"),
        gear.otherwise("dredging").alias("gear_type"),
        F.when(kind == "error", "ais_live").otherwise("gfw_fishing").alias("source"),
        F.when(kind != "error", F.col("value") / F.lit(100.0)).alias("effort_hours"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 4 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("SHIP "), F.col("event_id").cast("string")))
        .alias("ship_name"),
        F.expr("substring('FRESGBPT', cast(1 + 2 * (event_id % 4) as int), 2)").alias("flag"),
        F.col("event_id").alias("ordinal"),
    )


def marine_condition(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    marine = flag != "R"
    none = F.lit(None).cast("double")
    return table(spark, folder, "lineitem").select(
        F.expr(
            "timestampadd(HOUR, cast(l_orderkey % 720 as int), "
            "timestamp_ntz'2001-06-01 00:00:00')"
        ).alias("valid_at"),
        F.expr("42e0 + 0.25e0 * (l_partkey % 39)").alias("lat"),
        F.expr("-6e0 + 0.25e0 * (l_suppkey * 31 % 63)").alias("lon"),
        F.when(flag == "A", "marine_archive")
        .when(flag == "N", "marine_forecast")
        .otherwise("weather_archive")
        .alias("source"),
        F.when(~marine, F.expr("l_tax * 500e0")).alias("wind_speed_kmh"),
        F.when(~marine, F.expr("cast(floor(l_extendedprice / 7e0) as bigint) % 360 * 1e0")).alias(
            "wind_direction_deg"
        ),
        F.when(marine, F.expr("l_discount * 40e0")).alias("current_speed_kmh"),
        F.when(marine, F.expr("l_partkey * 11 % 360 * 1e0")).alias("current_direction_deg"),
        F.when(marine & (F.col("l_linenumber") != 7), F.expr("l_quantity / 10e0")).alias(
            "wave_height_m"
        ),
        F.when(marine, F.expr("cast(floor(l_extendedprice) as bigint) % 360 * 1e0")).alias(
            "wave_direction_deg"
        ),
        F.when(marine, F.expr("4e0 + l_linenumber")).alias("wave_period_s"),
        F.when(marine & (F.col("l_linenumber") % 5 != 0), F.expr("l_quantity / 20e0")).alias(
            "swell_height_m"
        ),
        none.alias("swell_direction_deg"),
        none.alias("swell_period_s"),
        none.alias("sea_surface_temperature_c"),
        F.when(marine, F.expr("(l_orderkey % 50 - 25) / 10e0")).alias("sea_level_m"),
    )


def condition(spark: SparkSession, folder: str) -> DataFrame:
    return merge_by_precedence(marine_condition(spark, folder))


DRIFT_KEYS = ("release_day", "day", "coastal_segment_id")
#: Rows of drift that a task sorts, about.
DRIFT_ROWS = 250_000


def drift_versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("release_day"),
        F.expr("date_add(cast(l_shipdate as date), l_linenumber)").alias("day"),
        F.col("l_suppkey").alias("coastal_segment_id"),
        F.col("l_returnflag").alias("model_version"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("id"),
        F.expr("l_quantity * l_discount").alias("drift_index"),
    )


def drift_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Rows are dealt out by segment first, to tasks whose number follows the rows (counted from the
    footers): no task sorts a whole split, and sums per segment and day need no further shuffle."""
    rows = table(spark, folder, "lineitem").count()
    dealt = spread(drift_versions(spark, folder), "coastal_segment_id", least=ceil(rows / DRIFT_ROWS))
    return keep_newest(dealt, DRIFT_KEYS).select(*DRIFT_KEYS, "drift_index")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows on days moved 26 years ahead, into the span the kinds cover."""
    kind = F.expr("element_at(array('gfw','weather_archive','drift','risk'), cast(o_orderkey % 4 + 1 as int))")
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("failed")
    )
    return (
        table(spark, folder, "orders")
        .groupBy(kind.alias("kind"), F.to_date(F.expr("add_months(o_orderdate, 312)")).alias("day"))
        .agg(
            F.min(status).alias("status"),
            F.min(F.expr("cast(o_orderkey % 3 as int)")).alias("attempts"),
            F.min(F.expr("cast(o_custkey % 168 as int)")).alias("deferrals"),
        )
        .withColumn(
            "error",
            F.when(
                F.col("status") == "failed",
                F.concat(F.lit("no input after "), F.col("deferrals").cast("string"), F.lit("\nsee log")),
            ),
        )
        .withColumn(
            "not_before",
            F.when(
                (F.col("status") == "pending") & (F.col("deferrals") > 0),
                F.expr("timestampadd(HOUR, deferrals, cast(day as timestamp_ntz))"),
            ),
        )
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """The days on which planning ran: every order day, moved as in `ledger`."""
    return (
        table(spark, folder, "orders")
        .select(F.to_date(F.expr("add_months(o_orderdate, 312)")).alias("as_of"))
        .distinct()
    )
