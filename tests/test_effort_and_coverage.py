from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewrack.constants import KINDS
from tidewrack.operators import coverage, effort, species

CELL = "mmsi string, recorded_at timestamp_ntz, lat double, lon double, gear_type string, effort_hours double, ordinal int"
AT = datetime(2024, 2, 3, 4)


def test_collapsing_takes_the_first_of_equal_cells(spark):
    rows = [("1", AT, 1.0, 1.0, "a", 0.5, 2), ("1", AT, 2.0, 2.0, "b", 0.5, 1),
            ("1", AT, 3.0, 3.0, "c", None, 0), ("2", AT, 4.0, 4.0, "d", None, 3)]
    got = {r.mmsi: (r.lat, r.effort_hours) for r in effort.collapse_cells(spark.createDataFrame(rows, CELL)).collect()}
    assert got == {"1": (2.0, 1.0), "2": (4.0, 0.0)}
    total = sum(r[5] or 0 for r in rows)
    assert sum(e for _, e in got.values()) == pytest.approx(total)


def test_seeds_need_effort(spark):
    rows = [("1", AT, 1.00001, 1.0, "Trawlers", 2.0, 0), ("2", AT, 1.0, 1.00004, None, 1.0, 1),
            ("3", AT, 1.0, 1.0, "trawlers", 0.0, 2), ("4", AT, 1.0, 1.0, "trawlers", None, 3)]
    seed = effort.release_seeds(spark.createDataFrame(rows, CELL)).collect()
    assert len(seed) == 1
    assert (seed[0].hour, seed[0].lat, seed[0].lon) == (4, 1.0, 1.0)
    assert seed[0].weight == pytest.approx((2.0 + 0.3) * 1.0 * 0.31)


def test_arrivals_keep_their_mass(spark):
    rows = [(date(2024, 1, 1), h, h % 3, float(h)) for h in range(100)]
    frame = spark.createDataFrame(rows, "release_day date, hour int, segment_id int, drift_index double")
    rolled = effort.arrival_rollup(frame)
    assert rolled.agg(F.sum("drift_index")).first()[0] == sum(range(100))
    assert rolled.agg(F.max("day")).first()[0] == date(2024, 1, 5)


def test_roster_fields_are_independent(spark):
    rows = [("1", AT, "gfw_fishing", "FR", "ONE"), ("1", AT + timedelta(hours=1), "gfw_fishing", None, ""),
            ("1", AT + timedelta(hours=2), "ais_live", "XX", "LIVE"), ("2", AT, "ais_live", "ES", "TWO")]
    frame = spark.createDataFrame(rows, "mmsi string, recorded_at timestamp_ntz, source string, flag string, ship_name string")
    got = effort.last_known(frame).collect()
    assert [tuple(r) for r in got] == [("1", "FR", None)]


def test_species_rules(spark):
    frame = spark.createDataFrame([("Orque",), ("Morse, Orque",), ("Licorne",)], "x string")
    got = {r.species_common: r.species_scientific for r in species.with_scientific_name(frame, F.col("x")).collect()}
    assert got == {"Orque": "Orcinus orca", "Morse, Orque": None, "Licorne": None}
    assert len(species.SPECIES) == 69


def replay(kind, calendar):
    """Plan and work every day in turn, keeping each bucket's state."""
    first, last = date.fromisoformat(kind.first), date.fromisoformat(kind.last)
    queue, ingested = {}, set()
    for today in calendar:
        horizon = min(last, today + timedelta(days=kind.ahead - kind.lag))
        day = max(today - timedelta(days=14), first)
        while day <= min(today + timedelta(days=3), horizon):
            shift = (day - date(2020, 1, 6)).days // kind.chunk * kind.chunk
            queue.setdefault(date(2020, 1, 6) + timedelta(days=shift), "pending")
            day += timedelta(days=1)
        for bucket, state in queue.items():
            if kind.volatile and state == "done" and bucket >= today - timedelta(days=kind.volatile):
                queue[bucket] = "pending"
        for bucket in queue:
            if queue[bucket] == "pending":
                low = max(bucket, first)
                high = min(bucket + timedelta(days=kind.chunk - 1), horizon)
                ingested.update(low + timedelta(days=i) for i in range((high - low).days + 1))
                queue[bucket] = "done"
    return ingested


@pytest.mark.parametrize("step", [1, 3])
def test_ingested_days_equal_a_replay(spark, step):
    calendar = [date(2026, 1, 15) + timedelta(days=i) for i in range(0, 140, step)]
    frame = spark.createDataFrame([(d,) for d in calendar], "as_of date")
    kinds = coverage.kinds(spark)
    got = {}
    for r in coverage.ingested_days(kinds, frame).collect():
        got.setdefault(r.kind, set()).add(r.day)
    for kind in KINDS:
        if not kind.rolling:
            assert got.get(kind.kind, set()) == replay(kind, calendar), kind.kind


def test_every_kind_is_covered_by_daily_planning(spark):
    calendar = spark.sql("SELECT explode(sequence(date'2026-01-15', date'2026-06-03')) AS as_of")
    kinds = coverage.kinds(spark)
    gaps = {r.kind: (r.share, r.first_gap) for r in coverage.coverage_gaps(kinds, calendar).collect()}
    assert gaps and all(share == 1.0 and gap is None for share, gap in gaps.values())
    frozen = kinds.withColumn("volatile", F.when(F.col("chunk") == 14, 0).otherwise(F.col("volatile")))
    broken = {r.kind: r.share for r in coverage.coverage_gaps(frozen, calendar).collect()}
    assert broken["weather_archive"] < 0.5 and broken["risk"] == 1.0


@pytest.mark.parametrize("done, kept", [(14, 1), (13, 0)])
def test_complete_buckets(spark, done, kept):
    days = spark.createDataFrame(
        [("a", date(2020, 1, 6) + timedelta(days=i), i < done) for i in range(14)], "kind string, day date, complete boolean"
    )
    assert coverage.complete_buckets(days).count() == kept


def test_status_and_failures(spark):
    rows = [("a", date(2024, 1, d), s, e, None, d) for d, s, e in
            [(1, "done", None), (2, "failed", "boom\nmore"), (3, "failed", None), (4, "pending", None)]]
    ledger = spark.createDataFrame(rows, "kind string, day date, status string, error string, not_before timestamp_ntz, deferrals int")
    status = coverage.coverage_status(ledger).first()
    assert (status.pending, status.running, status.done, status.failed) == (1, 0, 1, 2)
    assert [r.error for r in coverage.latest_failures(ledger).collect()] == ["-", "boom"]
    waiting = ledger.withColumn("not_before", F.lit("2024-02-01").cast("timestamp_ntz"))
    assert tuple(coverage.waiting_on_inputs(waiting, F.lit("2024-01-15").cast("timestamp_ntz")).first()) == ("a", 1, 4)


def test_landed_effort_becomes_seeds(spark, tmp_path):
    import json

    from tidewrack.sources.fishing import read_fishing_effort

    def cell(hours, gear="trawlers"):
        return {"mmsi": "7", "date": "2024-01-05T03:00Z", "lat": 44.0, "lon": 1.0, "hours": hours, "geartype": gear}

    deep = cell(2.0, "seiners")
    for _ in range(11):
        deep = {"x": [deep]} if isinstance(deep, dict) else [deep]
    text = [{"entries": [cell(1.0), cell(3.0, "set_gillnets"), cell(3.0)]}, deep, {"note": "a ] in text [ {"}]
    (tmp_path / "a.txt").write_text("\n".join(json.dumps(t) for t in text))
    landed = read_fishing_effort(spark, str(tmp_path))
    assert landed.count() == 4
    (row,) = effort.collapse_cells(landed).collect()
    assert (row.effort_hours, row.gear_type) == (9.0, "set_gillnets")
    seeds = effort.release_seeds(effort.collapse_cells(landed)).collect()
    assert [(s.hour, s.lat, s.lon) for s in seeds] == [(3, 44.0, 1.0)]
