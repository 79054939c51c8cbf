from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewrack.constants import MEASURES, WIND_MEASURES
from tidewrack.sources import tables
from tidewrack.operators import merging, shoreline

AT = datetime(2024, 1, 1, 5)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def condition(spark, entries):
    schema = "valid_at timestamp_ntz, lat double, lon double, forecast boolean, " + ", ".join(
        f"{m} double" for m in MEASURES
    )
    full = [
        (AT, lat, 1.0, forecast, *(measures.get(m) for m in MEASURES))
        for lat, forecast, measures in entries
    ]
    return spark.createDataFrame(full, schema)


def test_last_of_a_batch_wins(spark):
    batch = spark.createDataFrame([("a", 1, 0), ("a", None, 2), ("b", 3, 1)], "k string, v int, n int")
    assert rows(merging.last_per_key(batch, ["k"], ["n"]), "k", "v") == [("a", None), ("b", 3)]


def test_upsert_may_write_null_and_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, v int, w int")
    batch = spark.createDataFrame([("a", None, 7), ("c", 4, 8)], "k string, v int, w int")
    once = merging.merge_upsert(stored, batch, ["k"], overwrite=True)
    twice = merging.merge_upsert(once, batch, ["k"], overwrite=True)
    assert sorted(once.collect(), key=lambda r: r.k) == [("a", None, 7), ("b", 2, 6), ("c", 4, 8)]
    assert sorted(once.collect()[0:0]) == []
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}


def test_upsert_without_overwrite_keeps_the_first(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    assert rows(merging.merge_upsert(stored, batch, ["k"], overwrite=False), "k", "v") == [
        ("a", 1), ("b", 2),
    ]


def test_repeated_keys_in_a_batch_give_one_row(spark):
    stored = spark.createDataFrame([("a", 1, 0)], "k string, v int, n int")
    batch = spark.createDataFrame([("a", 7, 2), ("a", 9, 1), ("b", 5, 1), ("b", 4, 2)], "k string, v int, n int")
    after = merging.merge_upsert(stored, batch, ["k"], overwrite=True, order=["n"])
    assert rows(after, "k", "v") == [("a", 7), ("b", 4)]
    first = merging.merge_upsert(stored, batch, ["k"], overwrite=False, order=["n"])
    assert rows(first, "k", "v") == [("a", 1), ("b", 5)]
    assert merging.merge_upsert(stored, batch, ["k"], overwrite=True).count() == 2


def test_live_write_leaves_archived_rows_and_may_null_forecast_ones(spark):
    stored = condition(
        spark,
        [(1.0, False, {"wind_speed_kmh": 10.0, "wave_height_m": 2.0}),
         (2.0, True, {"wind_speed_kmh": 20.0, "wave_height_m": 3.0})],
    )
    live = condition(
        spark,
        [(1.0, None, {"wind_speed_kmh": 99.0}), (2.0, None, {}), (3.0, None, {"wind_speed_kmh": 7.0})],
    )
    after = merging.forecast_guarded_write(stored, live, WIND_MEASURES, live=True)
    assert rows(after, "lat", "forecast", "wind_speed_kmh", "wave_height_m") == [
        (1.0, False, 10.0, 2.0), (2.0, True, None, 3.0), (3.0, True, 7.0, None),
    ]


def test_archive_write_closes_the_whole_hour(spark):
    stored = condition(spark, [(2.0, True, {"wave_height_m": 3.0})])
    wind = condition(spark, [(2.0, None, {"wind_speed_kmh": 5.0})])
    archived = merging.forecast_guarded_write(stored, wind, WIND_MEASURES, live=False)
    waves = condition(spark, [(2.0, None, {"wave_height_m": 9.0})])
    after = merging.forecast_guarded_write(archived, waves, ["wave_height_m"], live=True)
    assert rows(after, "forecast", "wind_speed_kmh", "wave_height_m") == [(False, 5.0, 3.0)]


def test_replacing_with_nothing_still_deletes(spark):
    stored = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 2), 2), (None, 3)], "day date, v int")
    none = stored.limit(0)
    after = merging.replace_scope(stored, none, F.col("day") == date(2024, 1, 1))
    assert sorted(r.v for r in after.collect()) == [2, 3]


@pytest.mark.parametrize("stale, refused", [(5, "no"), (6, "yes")])
def test_prune_guard(spark, stale, refused):
    stored = spark.range(40).select(F.col("id").cast("string").alias("external_id"))
    keep = stored.filter(F.col("external_id").cast("int") >= stale)
    report = shoreline.prune_report(stored, keep).first()
    assert (report.stored, report.stale, report.allowed, report.refused) == (40, stale, 5, refused)
    if refused == "yes":
        with pytest.raises(ValueError, match="limit 5"):
            shoreline.guarded_prune(stored, keep)
    else:
        assert shoreline.guarded_prune(stored, keep).count() == 35


def test_stored_days_are_replaced_and_merged(spark, tmp_path):
    path = str(tmp_path / "job")
    schema = tables.TABLES["job"][1]
    day = lambda n: date(2024, 1, n)

    def jobs(*entries):
        return spark.createDataFrame([("risk", day(d), s, a, 0, None, None, None, None) for d, s, a in entries], schema)

    def stored():
        return sorted((r.day.day, r.status, r.attempts) for r in tables.read_table(spark, "job", path).collect())

    tables.upsert_days(spark, "job", path, jobs((1, "done", 1), (2, "done", 1), (3, "failed", 1)), overwrite=True)
    untouched = sorted(p.name for p in (tmp_path / "job" / "day=2024-01-01").glob("*.parquet"))
    again = jobs((3, "done", 3), (3, "failed", 2), (4, "done", 1))
    tables.upsert_days(spark, "job", path, again, overwrite=True, order=["attempts"])
    assert stored() == [(1, "done", 1), (2, "done", 1), (3, "done", 3), (4, "done", 1)]
    tables.replace_days(spark, "job", path, jobs((3, "pending", 0)), "2024-01-02", "2024-01-03")
    assert stored() == [(1, "done", 1), (3, "pending", 0), (4, "done", 1)]
    tables.replace_days(spark, "job", path, jobs(), "2024-01-03", "2024-01-04")
    assert stored() == [(1, "done", 1)]
    assert sorted(p.name for p in (tmp_path / "job" / "day=2024-01-01").glob("*.parquet")) == untouched
    with pytest.raises(ValueError):
        tables.replace_days(spark, "job", path, jobs((9, "done", 1)), "2024-01-01", "2024-01-02")


class Dying:
    """A file system whose owner dies before its n-th change."""

    def __init__(self, store, steps):
        self.store, self.steps = store, steps

    def __getattr__(self, name):
        real = getattr(self.store, name)
        if name not in ("rename", "delete", "create"):
            return real

        def changing(*a):
            if not self.steps:
                raise KeyboardInterrupt
            self.steps -= 1
            return real(*a)

        return changing


def test_a_replacement_that_dies_leaves_the_old_span_or_the_new_one(spark, tmp_path, monkeypatch):
    ddl = tables.TABLES["drift_daily"][1]

    def rows(*days):
        return spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, d), s, float(w)) for d, s, w in days], ddl)

    def content(path):
        return sorted((r.day.day, r.coastal_segment_id, r.drift_index) for r in tables.read_days_of(spark, "drift_daily", path).collect())

    old = [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1)]
    new = [(2, 3, 2), (4, 3, 2)]
    after = sorted([*[o for o in old if o[0] in (1, 5)], *new])
    real, seen = tables._store, set()
    for steps in range(20):
        path = str(tmp_path / f"t{steps}")
        rows(*old).write.partitionBy("day").parquet(path)

        shared = {}
        monkeypatch.setattr(tables, "_store", lambda s, p, shared=shared, steps=steps: (
            real(s, p)[0], shared.setdefault("store", Dying(real(s, p)[1], steps))))
        try:
            tables.replace_days(spark, "drift_daily", path, rows(*new), "2024-01-02", "2024-01-04")
            finished = True
        except KeyboardInterrupt:
            finished = False
        monkeypatch.setattr(tables, "_store", real)
        got = content(path)
        assert got in (sorted(old), after), steps
        seen.add(got == after)
        assert content(path) == got
        # The next replacement goes on from there.
        tables.replace_days(spark, "drift_daily", path, rows(), "2024-01-01", "2024-01-01")
        assert content(path) == [r for r in got if r[0] != 1]
        if finished:
            assert got == after
            break
    assert finished and seen == {False, True}
