import math
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import effort, geodesy, labels, scoring, timeline


def values(spark, rows, schema, *columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_event_window_shapes(spark):
    cases = {
        "2020-01-01": (datetime(2020, 1, 1, 12), 12.0),
        "2020-01-01/2020-01-03": (datetime(2020, 1, 2, 12), 36.0),
        "2020-01-01T10:00:00+02:00": (datetime(2020, 1, 1, 8), 0.0),
        "2020-01-01T06:00/2020-01-01T18:00Z": (datetime(2020, 1, 1, 12), 6.0),
        " 2020-01-01 / ": (datetime(2020, 1, 1, 12), 12.0),
        "2020-01-03/2020-01-01": None,
        "2020-01": None,
        "2020": None,
        "2020-02-30": None,
        "soon": None,
        "2020-01-01/late": None,
    }
    got = values(
        spark, [(i, t) for i, t in enumerate(cases)], "i int, t string",
        "i", timeline.event_window(F.col("t")).alias("w"),
    )
    for (text, want), (_, window) in zip(cases.items(), sorted(got), strict=True):
        if want is None:
            assert window is None, text
        else:
            # Collected instants are local times of the Python process, which runs in UTC.
            assert (window.recorded_at, window.half_width_hours) == want, text


def test_event_slots_use_a_leap_year(spark):
    days = [date(2023, 2, 28), date(2024, 2, 29), date(2023, 3, 1), date(2023, 12, 31)]
    got = values(spark, [(d,) for d in days], "d date", timeline.event_slot(F.col("d")))
    assert [g[0] for g in got] == [58, 59, 60, 365]


def test_chunk_buckets_floor_before_the_epoch(spark):
    days = [date(2020, 1, 5), date(2020, 1, 6), date(2020, 1, 19), date(2020, 1, 20)]
    got = values(spark, [(d,) for d in days], "d date", timeline.chunk_bucket(F.col("d"), 14))
    assert [g[0] for g in got] == [
        date(2019, 12, 23), date(2020, 1, 6), date(2020, 1, 6), date(2020, 1, 20),
    ]


def test_labels_and_weights(spark):
    got = values(
        spark, [(" Grand   dauphin ", " Trawlers "), ("x", None), ("y", "kites")],
        "label string, gear string",
        labels.normalize_label(F.col("label")), effort.gear_weight(F.col("gear")),
    )
    assert got == [("Grand dauphin", 1.0), ("x", 0.3), ("y", 0.3)]


def test_null_coordinates_give_null_distance(spark):
    lat = F.lit(None).cast("double")
    got = spark.range(1).select(
        geodesy.haversine_km(lat, F.lit(1.0), F.lit(2.0), F.lit(3.0)),
        scoring.logit(lat), scoring.log1p_scaled(lat, 1.0),
    ).first()
    assert tuple(got) == (None, None, None)


def test_index_is_flat_without_anchors(spark):
    got = spark.range(1).select(
        scoring.risk_index(F.lit(0.3), F.lit(0.2), F.lit(0.2)),
        scoring.risk_index(F.lit(0.3), F.lit(0.0), F.lit(0.5)),
        scoring.risk_index(F.lit(0.9), F.lit(0.1), F.lit(0.5)),
        scoring.risk_index(F.lit(0.0), F.lit(0.1), F.lit(0.5)),
    ).first()
    assert tuple(got) == (0.0, 0.0, 100.0, 0.0)


def test_unknown_direction_counts_as_zero(spark):
    east, north = geodesy.polar_to_uv(F.lit(36.0), F.lit(None).cast("double"), False)
    got = spark.range(1).select(east, north).first()
    assert got[0] == pytest.approx(0.0) and got[1] == pytest.approx(10.0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0.0, 1.0), min_size=2, max_size=40))
def test_index_follows_probability(spark, chances):
    rows = [(c,) for c in chances]
    got = values(
        spark, rows, "p double", "p", scoring.risk_index(F.col("p"), F.lit(0.01), F.lit(0.4))
    )
    ordered = [index for _, index in sorted(got)]
    assert ordered == sorted(ordered) and all(0.0 <= i <= 100.0 for i in ordered)


def test_distance_against_plain_python(spark):
    def plain(a, b):
        la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 6371.0088 * 2 * math.asin(math.sqrt(h))

    pairs = [(48.0, -5.0, 43.2, 5.1), (42.0, -6.0, 42.0, -6.0), (51.5, 9.5, 42.0, -6.0)]
    got = values(
        spark, pairs, "a double, b double, c double, d double",
        geodesy.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")),
    )
    for (a, b, c, d), (km,) in zip(pairs, got, strict=True):
        assert km == pytest.approx(plain((a, b), (c, d)), abs=1e-9)
