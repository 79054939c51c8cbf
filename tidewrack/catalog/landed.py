"""Readers, on payload texts that Spark builds from the test tables row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import SPARK_EVENT_TEXT, r6
from tidewrack.catalog.registry import query
from tidewrack.session import new_folder, settled
from tidewrack.sources import coastline, fishing, positions, sightings, weather


@query(
    "s1_hourly_weather",
    """WITH req AS (SELECT *, timestamp '2001-06-01' + to_hours(cast(l_orderkey % 720 AS int)) AS t,
              42e0 + 0.25e0 * (l_partkey % 39) AS lat, -6e0 + 0.25e0 * (l_suppkey * 31 % 63) AS lon FROM lineitem),
          cell AS (SELECT t, lat, lon, l_tax, l_discount, l_quantity FROM req
                   UNION ALL SELECT t, lat, lon + 0.25e0, l_tax, l_discount, l_quantity FROM req
                   WHERE l_linenumber % 2 = 0 AND l_quantity <= 25)
        SELECT valid_at, lat, lon, wind_speed_kmh, wind_direction_deg FROM (
          SELECT t AS valid_at, lat, lon, CASE WHEN l_quantity >= 10 THEN l_tax END AS wind_speed_kmh,
            cast(NULL AS double) AS wind_direction_deg FROM cell
          UNION ALL SELECT t + to_hours(1), lat, lon, l_discount, 90e0 FROM cell)
        WHERE wind_speed_kmh IS NOT NULL OR wind_direction_deg IS NOT NULL""",
)
def hourly_weather(spark, folder):
    rows = weather.parse_hourly_weather(
        weather_payloads(spark, folder), weather.PRODUCTS["weather_archive"]
    )
    return rows.withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz"))


def weather_payloads(spark, folder):
    """One request per line item: one cell answered alone, or two, the second perhaps too far."""
    location = """named_struct('latitude', lat + {lat_off}, 'longitude', lon + {lon_off}, 'hourly', named_struct(
        'time', array(date_format(t, "yyyy-MM-dd'T'HH:mm"), date_format(timestampadd(HOUR, 1, t), "yyyy-MM-dd'T'HH:mm")),
        'windspeed_10m', array(IF(l_quantity >= 10, l_tax, null), l_discount),
        'winddirection_10m', array(null, 90e0)))"""
    near = location.format(lat_off="0.1e0", lon_off="-0.1e0")
    far = location.format(lat_off="0e0", lon_off="0.25e0 + IF(l_quantity > 25, 0.2e0, 0.05e0)")
    text = F.expr(
        f"""IF(l_linenumber % 2 = 0,
          concat('{{"points":', to_json(array(array(lat, lon), array(lat, lon + 0.25e0))),
                 ',"answer":', to_json(array({near}, {far})), '}}'),
          concat('{{"points":', to_json(array(array(lat, lon))), ',"answer":', to_json({near}), '}}'))"""
    )
    return (
        inputs.table(spark, folder, "lineitem")
        .withColumn(
            "t",
            F.expr("timestampadd(HOUR, cast(l_orderkey % 720 AS int), timestamp_ntz'2001-06-01 00:00:00')"),
        )
        .withColumn("lat", F.expr("42e0 + 0.25e0 * (l_partkey % 39)"))
        .withColumn("lon", F.expr("-6e0 + 0.25e0 * (l_suppkey * 31 % 63)"))
        .select(text.alias("value"))
    )


@query(
    "s2_fishing_effort",
    """WITH cell AS (SELECT event_id, 0 AS cell, event_type, user_id, ts, value / 100e0 AS hours FROM events
          UNION ALL SELECT event_id, 1, event_type, user_id, ts, NULL FROM events WHERE event_type = 'click')
       SELECT event_id, cell, cast(user_id AS varchar) AS mmsi, date_trunc('hour', ts) AS recorded_at,
         round(42e0 + (event_id * 7919 % 9500) / 1000e0, 6) AS lat, 'gfw_fishing' AS source,
         CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS gear_type, hours AS effort_hours
       FROM cell WHERE event_type <> 'error'""",
)
def fishing_effort(spark, folder):
    return fishing.parse_fishing_effort(effort_payloads(spark, folder)).select(
        "event_id", "cell", "mmsi", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        r6("lat"), "source", "gear_type", "effort_hours",
    )


def effort_payloads(spark, folder):
    """Cells at two depths; `error` events have no vessel and `purchase` ones a blank gear."""
    cell = """named_struct('mmsi', IF(event_type = 'error', null, user_id),
        'lat', 42e0 + (event_id * 7919 % 9500) / 1000e0, 'lon', -6e0 + (event_id * 104729 % 15500) / 1000e0,
        'date', date_format(date_trunc('HOUR', ts), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        'hours', {hours}, 'geartype', IF(event_type = 'purchase', '', event_type), 'shipName', '')"""
    one, two = cell.format(hours="value / 100e0"), cell.format(hours="cast(null AS double)")
    text = F.expr(
        f"""IF(event_type = 'click',
          concat('{{"total":2,"entries":[{{"public:v3":[', to_json({one}), ']}},[[', to_json({two}), ']]]}}'),
          concat('{{"total":1,"entries":[{{"public:v3":[', to_json({one}), ']}}]}}'))"""
    )
    return inputs.table(spark, folder, "events").select("event_id", text.alias("value"))


@query(
    "s3_occurrences",
    """SELECT cast(o_orderkey AS varchar) AS external_id, 'gbif' AS source,
         CASE o_orderkey % 6 WHEN 0 THEN o_orderdate + to_hours(12) WHEN 1 THEN o_orderdate + to_hours(36)
           WHEN 2 THEN o_orderdate + to_minutes(510) ELSE o_orderdate + to_hours(36) END AS recorded_at,
         round(42e0 + (o_orderkey % 950) / 100e0, 6) AS lat,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Orcinus orca' ELSE 'Delphinus sp.' END AS species_scientific,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Orque' END AS species_common,
         cast(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 7 END AS int) AS individual_count,
         CASE o_orderkey % 6 WHEN 0 THEN 12e0 WHEN 1 THEN 36e0 WHEN 2 THEN 0e0 ELSE 30e0 END AS time_uncertainty_hours,
         'gbif_reported' AS location_precision
       FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 5) AND o_orderkey % 11 <> 0""",
)
def occurrences(spark, folder):
    """One page per order; some dates are unusable, some records have no longitude."""
    text = F.expr(
        f"""to_json(named_struct('endOfRecords', true, 'results', array(named_struct(
            'key', o_orderkey, 'decimalLatitude', 42e0 + (o_orderkey % 950) / 100e0,
            'decimalLongitude', IF(o_orderkey % 11 = 0, null, -1e0), 'eventDate', {SPARK_EVENT_TEXT},
            'species', IF(o_orderkey % 5 = 0, 'Orcinus orca', null), 'scientificName', 'Delphinus sp.',
            'individualCount', IF(o_orderkey % 7 = 0, null, o_orderkey % 7)))))"""
    )
    payloads = inputs.table(spark, folder, "orders").select(text.alias("value"))
    return sightings.parse_occurrences(payloads).select(
        "external_id", "source", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        r6("lat"), "species_scientific", "species_common", "individual_count",
        "time_uncertainty_hours", "location_precision",
    )


@query(
    "s4_event_text",
    """WITH line AS (SELECT o_orderkey AS k, -6e0 + (o_custkey % 300) / 10e0 AS lon, 47.5e0 AS lat,
              strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS day FROM orders),
          event AS (SELECT k, 0 AS nth, lon, lat, day, 2 AS n, 'Dauphin commun' AS common,
                           'Delphinus delphis' AS scientific, 'Brest' AS commune FROM line
                    UNION ALL SELECT k, 2, lon, lat, day, 1, 'Cachalot, Orque', NULL, 'Quimper' FROM line),
          numbered AS (SELECT *, row_number() OVER (PARTITION BY lat, lon, day, common, commune ORDER BY k, nth) - 1 AS i
                       FROM event WHERE lon BETWEEN -6 AND 9.5)
        SELECT substring(sha256(concat(printf('%.5f', lat), '|', printf('%.5f', lon), '|', day, '|', common, '|',
                 commune, '|', cast(i AS varchar))), 1, 32) AS external_id,
          cast(day AS timestamp) + to_hours(12) AS recorded_at, round(lon, 6) AS lon, common AS species_common,
          scientific AS species_scientific, cast(n AS int) AS individual_count FROM numbered""",
)
def event_text(spark, folder):
    """Two events and one unreadable one per order; months make many exact repeats."""
    orders = inputs.table(spark, folder, "orders")
    day = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd")
    events = F.concat(
        day, F.lit(" / 2 / Dauphin  commun / Brest, Finistère<br>unknown<br>"),
        day, F.lit(" / 1 / Cachalot, Orque / Quimper"),
    )
    lines = orders.select(
        F.expr("cast(-6e0 + (o_custkey % 300) / 10e0 AS string)").alias("lon"),
        F.lit(" 47.5").alias("lat"),
        events.alias("events"),
        F.floor(F.col("o_orderkey") / 131072).alias("run"),
        "o_orderkey",
    )
    return sightings.parse_event_text(lines, ["run"], ["o_orderkey"]).select(
        "external_id", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        r6("lon"), "species_common", "species_scientific", "individual_count",
    )


@query(
    "s5_coastline",
    """SELECT line_id, cast(0 AS int) AS part, cast(count(*) AS int) AS points, round(min(lon), 6) AS west,
         round(max(lat), 6) AS north
       FROM fx_line_point WHERE line_id % 3 <> 2 GROUP BY 1
       HAVING bool_or(lat BETWEEN 38 AND 55.5 AND lon BETWEEN -10 AND 13.5)
       UNION ALL SELECT line_id, 1, 2, 5, 46 FROM fx_line_point WHERE line_id % 3 = 1 AND seq = 0""",
)
def coast(spark, folder):
    """One collection per line: a plain line, a multi-line with heights, or a polygon."""
    coordinates = "transform(points, p -> array(p.lon, p.lat))"
    with_height = "transform(points, p -> array(p.lon, p.lat, 3.5e0))"
    text = F.expr(
        f"""concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":',
          CASE line_id % 3
            WHEN 0 THEN concat('{{"type":"LineString","coordinates":', to_json({coordinates}), '}}')
            WHEN 1 THEN concat('{{"type":"MultiLineString","coordinates":[', to_json({with_height}),
                               ',[[5,45],[6,46]]]}}')
            ELSE concat('{{"type":"Polygon","coordinates":[', to_json({coordinates}), ']}}') END, '}}]}}')"""
    )
    payloads = inputs.lines(spark, folder).select("line_id", text.alias("value"))
    rows = coastline.parse_coastline(payloads)
    return rows.select(
        "line_id",
        "part",
        F.size("points").alias("points"),
        r6("west", F.array_min(F.transform("points", lambda p: p["lon"]))),
        r6("north", F.array_max(F.transform("points", lambda p: p["lat"]))),
    )


@query(
    "s5_split_collection",
    """SELECT cast(count(*) AS int) AS points, round(min(lon), 6) AS west, round(max(lat), 6) AS north
       FROM fx_line_point WHERE line_id % 3 <> 2 GROUP BY line_id
       HAVING bool_or(lat BETWEEN 38 AND 55.5 AND lon BETWEEN -10 AND 13.5)""",
)
def split_collection(spark, folder):
    """All lines as one collection in one file, which its byte ranges' tasks read."""
    coordinates = "to_json(transform(points, p -> array(p.lon, p.lat)))"
    kind = "IF(line_id % 3 = 2, 'MultiPoint', 'LineString')"
    feature = f"""concat('{{"type":"Feature","properties":{{"name":"{{' , line_id, '\\\\"]"}},"geometry":{{"type":"', {kind},
        '","coordinates":', {coordinates}, '}}}},')"""

    def collection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[']})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ['{"type":"Feature","geometry":null}]}']})

    # Texts are made by many tasks; the one that writes the file passes them on, batch by batch.
    texts = settled(inputs.lines(spark, folder).select(F.expr(feature).alias("value")))
    path = f"{new_folder(spark, 'collection')}/all"
    texts.coalesce(1).mapInArrow(collection, "value string").write.text(path)
    rows = coastline.read_coastline(spark, path)
    return rows.select(
        F.size("points").alias("points"),
        r6("west", F.array_min(F.transform("points", lambda p: p["lon"]))),
        r6("north", F.array_max(F.transform("points", lambda p: p["lat"]))),
    )


@query(
    "s6_position_reports",
    """SELECT event_id, cast(user_id AS varchar) AS mmsi, date_trunc('second', ts) AS at_time,
         round(42e0 + (event_id * 7919 % 9500) / 1000e0, 6) AS lat,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'BOAT ' || cast(user_id AS varchar) END AS name
       FROM events WHERE event_type NOT IN ('error', 'signup')""",
)
def reports(spark, folder):
    """Frames of every kind: other messages (`error`), broken text (`signup`), blank names."""
    return positions.parse_position_reports(frames(inputs.table(spark, folder, "events"))).select(
        "event_id", "mmsi", F.col("at_time").cast("timestamp_ntz").alias("at_time"), r6("lat"), "name"
    )


def frames(events):
    """Position frames of events, for batch and stream."""
    text = F.expr(
        """CASE WHEN event_type = 'signup' THEN concat('{"MessageType": "Posi', user_id)
          ELSE to_json(named_struct(
            'MessageType', IF(event_type = 'error', 'ShipStaticData', 'PositionReport'),
            'MetaData', named_struct('MMSI', IF(event_id % 2 = 0, user_id, null),
               'MMSI_String', cast(user_id AS string),
               'ShipName', IF(event_id % 3 = 0, '  ', concat('BOAT ', user_id, '  ')),
               'time_utc', concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), '456 +0000 UTC')),
            'Message', named_struct('PositionReport', named_struct(
               'Latitude', 42e0 + (event_id * 7919 % 9500) / 1000e0,
               'Longitude', -6e0 + (event_id * 104729 % 15500) / 1000e0)))) END"""
    )
    return events.select("event_id", text.alias("value"))


@query(
    "s8_grid_points",
    """SELECT segment_id, round(center_lat + 0.00001e0, 4) AS lat, round(center_lon + 0.00001e0, 4) AS lon FROM fx_segment
       UNION ALL SELECT segment_id, 43.25, length_km FROM fx_segment""",
)
def grid_points(spark, folder):
    text = F.expr(
        """to_json(named_struct('source', 'test', 'points', array(
             array(center_lat + 0.00001e0, center_lon + 0.00001e0), array(43.25e0, length_km))))"""
    )
    payloads = inputs.segments(spark, folder).select("segment_id", text.alias("value"))
    return coastline.parse_grid_points(payloads)
