import hashlib
import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewrack.sources import coastline, fishing, positions, sightings, tables, weather
from tidewrack.sources import features as features_source
from tidewrack.streaming import positions as live


def texts(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def location(lat, lon, speed, direction=(10.0, 20.0)):
    return {"latitude": lat, "longitude": lon, "hourly": {
        "time": ["2024-01-01T00:00", "2024-01-01T01:00"],
        "windspeed_10m": list(speed), "winddirection_10m": list(direction)}}


def test_hourly_weather(spark, tmp_path):
    payloads = [
        {"points": [[45.0, -2.0], [45.25, -2.0]],
         "answer": [location(45.1, -2.1, (None, 5.0), (None, 7.0)), location(45.4, -2.0, (1.0, 2.0))]},
        {"points": [[46.0, -2.0]], "answer": location(46.0, -1.875, (3.0, None))},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, payloads)))
    rows = weather.read_hourly_weather(spark, str(tmp_path), weather.PRODUCTS["weather_archive"])
    got = sorted((r.lat, r.valid_at.hour, r.wind_speed_kmh, r.wind_direction_deg) for r in rows.collect())
    assert got == [(45.0, 1, 5.0, 7.0), (46.0, 0, 3.0, 10.0), (46.0, 1, None, 20.0)]


def test_malformed_weather_is_an_error(spark):
    product = weather.PRODUCTS["weather_archive"]
    short = {"points": [[1, 2], [3, 4]], "answer": [location(1, 2, (1, 2))]}
    with pytest.raises(PySparkException, match="do not match"):
        weather.parse_hourly_weather(texts(spark, short), product).collect()
    uneven = {"points": [[1.0, 2.0]], "answer": location(1.0, 2.0, (1.0,))}
    with pytest.raises(PySparkException, match="unequal"):
        weather.parse_hourly_weather(texts(spark, uneven), product).collect()


def test_fishing_effort_at_any_depth(spark, tmp_path):
    cell = {"mmsi": 7, "lat": 1.5, "lon": 2, "date": "2024-01-01T05:00:00Z", "hours": None, "shipName": "", "geartype": "x"}
    payload = {"entries": [{"d": [cell, {**cell, "mmsi": ""}, {**cell, "lat": None}]}, {"e": {"f": [[{**cell, "hours": 2}]]}}], "n": 3}
    (tmp_path / "a.json").write_text(json.dumps(payload))
    got = [(r.mmsi, r.lat, r.recorded_at, r.ship_name, r.gear_type, r.effort_hours)
           for r in fishing.read_fishing_effort(spark, str(tmp_path)).orderBy("ordinal").collect()]
    at = datetime(2024, 1, 1, 5)
    assert got == [("7", 1.5, at, None, "x", None), ("7", 1.5, at, None, "x", 2.0)]
    with pytest.raises(PySparkException, match="JSON"):
        fishing.parse_fishing_effort(texts(spark, '{"lat": NaN}')).collect()


def test_fishing_effort_of_any_depth_in_document_order(spark, tmp_path):
    def cell(n):
        return {"mmsi": n, "lat": n, "lon": "2.5", "date": "2024-01-01T05:00:00Z", "nested": {"lat": 99}}

    deep = cell(1)
    for n in range(40):
        deep = {"z": [[], deep]} if n % 2 else [deep, "x"]
    wide = {"b": cell(3), "a": [cell(4), {"y": cell(5), "c": cell(6)}], "0": cell(7)}
    got = {}
    payloads = texts(spark, {"q": deep, "e": cell(2)}, wide, "null", "[]", json.dumps(cell(8)))
    rows = payloads.unionByName(spark.createDataFrame([(None,)], "value string")).withColumn("n", F.monotonically_increasing_id())
    for r in fishing.parse_fishing_effort(rows).orderBy("n", "cell").collect():
        got.setdefault(r.n, []).append((r.cell, r.mmsi, r.lat, r.lon))
    assert sorted(got.values()) == [
        [(0, "1", 1.0, 2.5), (1, "2", 2.0, 2.5)],
        [(0, "3", 3.0, 2.5), (1, "4", 4.0, 2.5), (2, "5", 5.0, 2.5), (3, "6", 6.0, 2.5), (4, "7", 7.0, 2.5)],
        [(0, "8", 8.0, 2.5)],
    ]


def test_fishing_effort_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"a": [[[{"mmsi": 7, "lat": 1, "lon": 2, "date": "2024-01-01T05:00:00Z"}]]]}))
    cells = fishing.parse_fishing_effort(spark.readStream.text(str(tmp_path / "in")))
    seen = []
    query = cells.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
        lambda batch, _: seen.extend(r.mmsi for r in batch.collect())).start()
    query.awaitTermination()
    assert seen == ["7"]


def test_occurrences(spark):
    base = {"key": 1, "decimalLatitude": 45.0, "decimalLongitude": -1.0, "eventDate": "2020-01-01"}
    page = {"endOfRecords": True, "results": [
        {**base, "species": "Orcinus orca", "individualCount": 0},
        {**base, "key": 2, "scientificName": "Other"}, {**base, "key": 3, "eventDate": "2020-01"},
        {**base, "key": 4, "decimalLatitude": None}]}
    got = {r.external_id: (r.species_common, r.species_scientific, r.individual_count)
           for r in sightings.parse_occurrences(texts(spark, page, "{}")).collect()}
    assert got == {"1": ("Orque", "Orcinus orca", 0), "2": (None, "Other", 1)}


def test_event_text_files(spark, tmp_path):
    event = "2024-01-05 / 2 / Dauphin  commun / Brest, 29"
    lines = ["lon\tlat\tname\tevents", f"-4.5\t48.4\tx\t{event}<br>{event}<br>junk", "bad\t48\tx\t" + event,
             "-4.5\t48.4\tx", f"-4.5\t10\tx\t{event}", "-4.5\t48.4\tx\t2024-01-05 / 1 / Orque, Morse / \"Brest\"",
             f"-4.5\t48.4\tx\t{event}"]
    (tmp_path / "a.tsv").write_text("\n".join(lines), encoding="utf-8")
    rows = sightings.read_event_text(spark, str(tmp_path)).collect()
    want = {hashlib.sha256(f"48.40000|-4.50000|2024-01-05|Dauphin commun|Brest|{i}".encode()).hexdigest()[:32] for i in range(3)}
    want.add(hashlib.sha256(b'48.40000|-4.50000|2024-01-05|Orque, Morse|"Brest"|0').hexdigest()[:32])
    assert {r.external_id for r in rows} == want and len(rows) == 4
    assert {r.recorded_at for r in rows} == {datetime(2024, 1, 5, 12)}


def test_coastline(spark, tmp_path):
    def feature(kind, coordinates):
        return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}}

    collection = {"type": "FeatureCollection", "features": [
        feature("LineString", [[-2.0, 45.0, 9.9], [-2.1, 45.1]]), feature("LineString", [[100, 0], [101, 0]]),
        feature("MultiLineString", [[[-3, 44], [-3, 45]], [[0, 0], [13.5, 55.5]]]), feature("Polygon", [[[0, 45], [1, 45]]]),
        {"type": "Feature", "geometry": None}]}
    (tmp_path / "a.json").write_text(json.dumps(collection, indent=1))
    rows = coastline.read_coastline(spark, str(tmp_path)).collect()
    assert sorted([tuple(p) for p in r.points] for r in rows) == [
        [(0.0, 0.0), (55.5, 13.5)], [(44.0, -3.0), (45.0, -3.0)], [(45.0, -2.0), (45.1, -2.1)],
    ]
    assert len({r.line_id for r in rows}) == 3


def test_one_collection_in_many_byte_ranges(spark, tmp_path):
    rng = random.Random(6)
    odd = ['a{b', 'c}', '"', '\\', '\\"{', ']', '{"type": "Feature"}', "é}"]

    def feature(n):
        points = [[round(rng.uniform(-5, 9), 3), round(rng.uniform(43, 51), 3)] for _ in range(rng.choice([2, 3, 400]))]
        kind, coordinates = rng.choice([("LineString", points), ("MultiLineString", [points, points[:2]]), ("Point", points[0])])
        return {"type": "Feature", "properties": {"name": rng.choice(odd) * rng.randint(0, 3), "n": {"m": [{"k": n}]}},
                "geometry": {"type": kind, "coordinates": coordinates}}

    features = [feature(n) for n in range(200)]
    text = json.dumps({"type": "FeatureCollection", "crs": {"properties": {"x": "{"}}, "features": features}, ensure_ascii=False)
    broken = text.replace('"Point", "coordinates": [', '"Point", "coordinates": [!', 3)
    (tmp_path / "one").mkdir()
    # Two collections in a file, and a file whose features are partly unreadable.
    (tmp_path / "one" / "a.json").write_text(text + "\n" + json.dumps({"features": features[:5]}, indent=2), encoding="utf-8")
    (tmp_path / "one" / "b.json").write_text(broken, encoding="utf-8")
    want = [[tuple(reversed(p)) for p in line]
            for f in [*features, *features[:5], *features]
            for line in ({"LineString": [f["geometry"]["coordinates"]], "MultiLineString": f["geometry"]["coordinates"]}
                         .get(f["geometry"]["type"], []))]
    before, ids = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in (64 << 20, 24_000, 1_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = coastline.read_coastline(spark, str(tmp_path / "one")).collect()
            assert sorted([tuple(p) for p in r.points] for r in rows) == sorted(want)
            ids.append(sorted(r.line_id for r in rows))
            report = {r.file.split("/")[-1]: (r.lines, r.broken) for r in coastline.coastline_report(spark, str(tmp_path / "one")).collect()}
            lines = [sum(f["geometry"]["type"] != "Point" for f in own) for own in (features, features[:5])]
            assert report == {"a.json": (sum(lines), 0), "b.json": (lines[0], 3)}
        ranges = features_source._records(spark, str(tmp_path / "one")).select("file", "block").distinct().count()
        assert ranges > 32 and ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(ids[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "c.json").write_text(text[:-9])
    with pytest.raises(ValueError, match="ends inside"):
        coastline.read_coastline(spark, str(tmp_path / "two"))


def test_texts_that_are_not_json_are_errors(spark):
    for parse in (sightings.parse_occurrences, coastline.parse_coastline):
        assert parse(spark.createDataFrame([(None,), ("{}",), ('{"results": null, "features": []}',)], "value string")).count() == 0
        with pytest.raises(PySparkException, match="not JSON"):
            parse(texts(spark, "{}", '{"results": [')).collect()


def test_grid_points(spark):
    got = coastline.parse_grid_points(texts(spark, {"points": [[42.00004, 3], [42, 3.25]]}))
    assert sorted(tuple(r) for r in got.collect()) == [(42.0, 3.0), (42.0, 3.25)]


def frame(mmsi, at, lat=45.0, name="A ", **meta):
    return {"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi, "time_utc": at, "ShipName": name, **meta},
            "Message": {"PositionReport": {"Latitude": lat, "Longitude": -2.0}}}


def test_position_frames(spark):
    at = "2024-01-01 05:06:07.891 +0000 UTC"
    got = positions.parse_position_reports(texts(
        spark, frame(1, at), frame(None, at, name="  ", MMSI_String="2"), frame(0, at, MMSI_String="3"),
        frame(4, at, lat=None), frame(None, at), {"MessageType": "Other"}, "{broken", frame(5, "bad"),
    )).collect()
    rows = {r.mmsi: (r.at_time, r.name) for r in got}
    assert set(rows) == {"1", "2", "3", "5"}
    assert rows["1"] == (datetime(2024, 1, 1, 5, 6, 7), "A") and rows["2"][1] is None
    assert abs((rows["5"][0] - datetime.now()).total_seconds()) < 300


def test_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS valid_at", "id").write.parquet(path)
    scan = tables.scan_span(spark.read.parquet(path), "valid_at", "2024-01-01", "2024-01-02")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(valid_at" in plan and "LessThan(valid_at" in plan
    assert scan.count() == 10


def test_stored_tables_round_trip(spark, tmp_path):
    for name, (keys, ddl) in tables.TABLES.items():
        path = str(tmp_path / name)
        empty = spark.createDataFrame([], ddl)
        tables.write_table(empty, path)
        assert tables.read_table(spark, name, path).schema == empty.schema
        assert set(keys) <= set(empty.columns)


REPORT = "mmsi string, at string, lat double, name string"
ROSTER = "mmsi string, flag string, gear_type string, ship_name string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").json(folder)


def arrived(spark, inbox):
    return spark.readStream.schema(REPORT).json(inbox).selectExpr(
        "mmsi", "cast(at as timestamp) AS at_time", "lat", "-2D AS lon", "name")


def drained(spark, tmp_path, roster, delay="30 minutes", **how):
    """The query after it took all that has arrived; folders are in, table and state."""
    query = live.start_hourly(
        arrived(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state"), lambda s: roster,
        delay=delay, once=True, **how)
    query.awaitTermination()
    return query


def stored(spark, tmp_path):
    return {(r.mmsi, r.recorded_at.day, r.recorded_at.hour): (r.lat, r.ship_name)
            for r in live.read_hourly(spark, str(tmp_path / "table")).collect()}


def still_open(spark, tmp_path):
    return {(r.mmsi, r.recorded_at.day, r.recorded_at.hour): r.lat
            for r in live.open_hours(spark, str(tmp_path / "state")).collect()}


def test_hourly_stream_first_write_wins_and_resumes(spark, tmp_path):
    roster = spark.createDataFrame([("1", "FR", "trawlers", "OLD"), ("2", None, None, None)], ROSTER)
    put(spark, str(tmp_path / "in"), [
        ("1", "2024-01-01 05:10:00", 1.0, None), ("1", "2024-01-01 05:50:00", 2.0, None),
        ("9", "2024-01-01 05:50:00", 9.0, None), ("2", "2024-01-01 07:00:00", 3.0, "TWO")])
    # Hour 5 is closed (watermark 6:30); hour 7 is open and stays in state, without the unknown vessel.
    query = drained(spark, tmp_path, roster)
    assert stored(spark, tmp_path) == {("1", 1, 5): (2.0, "OLD")}
    assert still_open(spark, tmp_path) == {("2", 1, 7): 3.0}
    assert live.roster_counts(query) == (4, 1)
    # A late repeat of a written hour is dropped; hour 7 closes with its latest position.
    put(spark, str(tmp_path / "in"), [
        ("1", "2024-01-01 05:59:00", 7.0, None), ("2", "2024-01-01 07:30:00", 4.0, None),
        ("9", "2024-01-01 07:31:00", 4.0, None), ("1", "2024-01-01 09:00:00", 5.0, None)])
    query = drained(spark, tmp_path, roster)
    assert stored(spark, tmp_path) == {("1", 1, 5): (2.0, "OLD"), ("2", 1, 7): (4.0, None)}
    assert live.roster_counts(query) == (4, 1)


def test_an_hour_never_written_is_stored_once_however_late(spark, tmp_path):
    roster = spark.createDataFrame([("1", "FR", "x", "A")], ROSTER)
    inbox = str(tmp_path / "in")
    put(spark, inbox, [("1", "2024-01-05 05:10:00", 1.0, None), ("1", "2024-01-05 08:00:00", 2.0, None)])
    drained(spark, tmp_path, roster)
    first = {("1", 5, 5): (1.0, "A")}
    assert stored(spark, tmp_path) == first
    # Three days late: two reports of one hour, the later one counts; the written hour 5 takes none.
    put(spark, inbox, [("1", "2024-01-02 03:40:00", 7.0, None), ("1", "2024-01-02 03:20:00", 6.0, None),
                       ("1", "2024-01-05 05:55:00", 8.0, None)])
    drained(spark, tmp_path, roster)
    assert stored(spark, tmp_path) == {**first, ("1", 2, 3): (7.0, "A")}
    put(spark, inbox, [("1", "2024-01-02 03:59:00", 9.0, None)])
    drained(spark, tmp_path, roster)
    assert stored(spark, tmp_path) == {**first, ("1", 2, 3): (7.0, "A")}
    assert still_open(spark, tmp_path) == {("1", 5, 8): 2.0}


def test_marks_have_their_time_and_the_table_still_decides(spark, tmp_path):
    roster = spark.createDataFrame([("1", "FR", "x", "A")], ROSTER)
    inbox, keep = str(tmp_path / "in"), timedelta(hours=3)
    put(spark, inbox, [("1", "2024-01-05 05:10:00", 1.0, None), ("1", "2024-01-05 08:00:00", 2.0, None)])
    drained(spark, tmp_path, roster, keep=keep)
    put(spark, inbox, [("1", "2024-01-05 13:00:00", 3.0, None)])
    drained(spark, tmp_path, roster, keep=keep)
    state = spark.read.format("statestore").option("stateVarName", "hours").load(str(tmp_path / "state"))
    # 5:00 + 1 h + 3 h < 12:30: its mark is gone, that of 8:00 went with it at 12:00; 13:00 is open.
    assert [(len(r.value.open), list(r.value.emitted)) for r in state.collect()] == [(1, [])]
    put(spark, inbox, [("1", "2024-01-05 05:55:00", 8.0, None)])
    drained(spark, tmp_path, roster, keep=keep)
    assert stored(spark, tmp_path) == {("1", 5, 5): (1.0, "A"), ("1", 5, 8): (2.0, "A")}


def test_closed_and_open_hours_are_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    roster = spark.createDataFrame([(str(v), "FR", "x", None) for v in range(6)], ROSTER)
    base, rows = datetime(2024, 3, 1), []
    for n in range(3):
        part = [(str(rng.randrange(8)), str(base + timedelta(hours=8 * n, seconds=rng.randrange(8 * 3600))), float(rng.randrange(999)), None)
                for _ in range(120)]
        rows += part
        put(spark, str(tmp_path / "in"), part)
        drained(spark, tmp_path, roster)
        last = {}
        for mmsi, at, lat, _ in rows:
            hour = datetime.fromisoformat(at).replace(minute=0, second=0)
            if int(mmsi) < 6:
                last[mmsi, hour.day, hour.hour] = max(last.get((mmsi, hour.day, hour.hour), ("", 0.0)), (at, lat))
        closed, open_ = stored(spark, tmp_path), still_open(spark, tmp_path)
        assert not set(closed) & set(open_)
        assert {k: v[0] for k, v in closed.items()} | open_ == {k: v[1] for k, v in last.items()}
    # What the query leaves behind can be stored as it is; running that again changes nothing.
    for _ in range(2):
        live.flush_open_hours(spark, str(tmp_path / "table"), str(tmp_path / "state"), lambda s: roster)
        assert {k: v[0] for k, v in stored(spark, tmp_path).items()} == {k: v[1] for k, v in last.items()}
    # A flushed hour that closes later stays as it was flushed.
    put(spark, str(tmp_path / "in"), [("1", "2024-03-01 23:59:59.9", -1.0, None), ("0", "2024-03-03 00:00:00", 1.0, None)])
    drained(spark, tmp_path, roster)
    assert {k: v[0] for k, v in stored(spark, tmp_path).items() if k in last} == {
        k: v[1] for k, v in last.items()} | ({} if ("1", 1, 23) in last else {("1", 1, 23): -1.0})


def test_a_query_is_resumed_when_its_roster_is_old():
    class Query:
        def __init__(self, ends):
            self.ends, self.stopped = ends, False

        def awaitTermination(self, timeout):
            return self.ends

        def stop(self):
            self.stopped = True

    made = []

    def start():
        made.append(Query(ends=len(made) == 2))
        return made[-1]

    live.follow_hourly(start, timedelta(seconds=0))
    assert [q.stopped for q in made] == [True, True, False]
    made.clear()
    live.follow_hourly(start, timedelta(hours=1), until=lambda: True)
    assert [q.stopped for q in made] == [True]


def test_a_resumed_query_lets_new_vessels_in(spark, tmp_path):
    known = [("1", "FR", "x", "A")]
    put(spark, str(tmp_path / "in"), [("1", "2024-01-01 05:10:00", 1.0, None), ("2", "2024-01-01 05:10:00", 1.0, None)])
    drained(spark, tmp_path, spark.createDataFrame(known, ROSTER))
    known.append(("2", "FR", "x", "B"))
    put(spark, str(tmp_path / "in"), [("2", "2024-01-01 05:05:00", 2.0, None), ("9", "2024-01-01 07:00:00", 1.0, None)])
    drained(spark, tmp_path, spark.createDataFrame(known, ROSTER))
    assert stored(spark, tmp_path) == {("1", 1, 5): (1.0, "A"), ("2", 1, 5): (2.0, "B")}


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    roster = spark.createDataFrame([("1", "FR", "x", "A")], ROSTER)
    write = live.store_new_hours(str(tmp_path / "t"), lambda s: roster)
    batch = spark.createDataFrame([("1", datetime(2024, 1, 1, 5), 1.0, 2.0, None)],
                                  "mmsi string, recorded_at timestamp, lat double, lon double, name string")
    write(batch, 0)
    write(batch, 0)
    again = batch.withColumn("lat", F.lit(8.0)).unionAll(batch.withColumn("recorded_at", F.lit(datetime(2024, 1, 1, 6))))
    write(again, 1)
    write(again, 1)
    got = sorted((r.recorded_at.hour, r.lat) for r in live.read_hourly(spark, str(tmp_path / "t")).collect())
    assert got == [(5, 1.0), (6, 1.0)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["day=2024-01-01"]
    assert live.read_days(spark, str(tmp_path / "t"), [date(2024, 1, 1), date(2024, 1, 2)]).count() == 2


def test_stream_result_equals_batch_on_closed_hours(spark, small):
    from tidewrack.catalog import QUERIES

    stream = {(r.mmsi, r.recorded_at): r.lat for r in QUERIES["r1_r5_hourly_positions"](spark, small).collect()}
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr(
        "cast(user_id AS string) AS mmsi", "cast(ts AS timestamp) AS at_time",
        "42e0 + (event_id * 7919 % 9500) / 1000e0 AS lat", "0D AS lon", "cast(null AS string) AS name")
    batch = {(r.mmsi, r.recorded_at): round(r.lat, 6) for r in live.hourly_positions(events).collect()}
    assert stream and all(batch[key] == lat for key, lat in stream.items())


def test_the_collection_is_written_without_a_sort(spark, small, monkeypatch):
    from pyspark.sql import DataFrame

    from tidewrack.catalog import landed

    def refused(*_):
        raise AssertionError("the task that writes the file holds and sorts all of it")

    monkeypatch.setattr(DataFrame, "sortWithinPartitions", refused)
    assert landed.split_collection(spark, small).count() == spark.sql(
        f"SELECT count(*) FROM parquet.`{small}/customer.parquet` WHERE c_custkey % 3 <> 2"
    ).first()[0]
