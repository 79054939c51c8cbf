"""Live position frames: JSON text to position reports, on streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.labels import blank_to_null
from tidewrack.functions.timeline import utc_instant

FRAME = (
    "MessageType string,"
    " MetaData struct<MMSI: string, MMSI_String: string, ShipName: string, time_utc: string>,"
    " Message struct<PositionReport: struct<Latitude: double, Longitude: double>>"
)


def parse_position_reports(frames: DataFrame, text: str = "value") -> DataFrame:
    """(mmsi, at_time, lat, lon, name); other messages and frames that are not JSON drop.

    A report without a usable time takes its arrival time.
    """
    keep = [c for c in frames.columns if c != text]
    report = frames.select(*keep, F.from_json(F.col(text), FRAME).alias("m"))
    meta, position = F.col("m.MetaData"), F.col("m.Message.PositionReport")
    known = F.nullif(F.nullif(meta["MMSI"], F.lit("")), F.lit("0"))
    stamp = utc_instant(F.substring(meta["time_utc"], 1, 19))
    return (
        report.filter(F.col("m.MessageType") == "PositionReport")
        .select(
            *keep,
            F.coalesce(known, F.nullif(meta["MMSI_String"], F.lit(""))).alias("mmsi"),
            F.coalesce(stamp, F.current_timestamp()).alias("at_time"),
            position["Latitude"].alias("lat"),
            position["Longitude"].alias("lon"),
            blank_to_null(meta["ShipName"]).alias("name"),
        )
        .dropna(subset=["mmsi", "lat", "lon"])
    )
