import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import kernel, lattice, longlines, nearest, shoreline
from tidewrack.sources import rasters

SITE = "segment_id int, lat double, lon double"


def haversine(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 6371.0088 * 2 * math.asin(math.sqrt(h))


def brute_snap(lat, lon, sites):
    i = min(max(round((lat - 42.0) / 0.02), 0), 475)
    j = min(max(round((lon + 6.0) / 0.02), 0), 775)
    node = (42.0 + i * 0.02, -6.0 + j * 0.02)
    best = min(
        (
            (math.hypot((node[0] - y) * 110.6, (node[1] - x) * 111.3 * math.cos(math.radians(y))), s)
            for s, y, x in sites
        ),
        default=(math.inf, None),
    )
    return best if best[0] <= 15.0 else None


def test_snapping_equals_brute_force_with_dense_and_sparse_sites(spark):
    rng = random.Random(3)
    # A third of all sites share one small spot; others are far apart.
    sites = [(i, 46.0 + rng.random() * 0.01, -2.0 + rng.random() * 0.01) for i in range(200)]
    sites += [(200 + i, 42 + rng.random() * 9.6, -6 + rng.random() * 15.6) for i in range(400)]
    events = [(i, 41.9 + rng.random() * 9.8, -6.1 + rng.random() * 15.8) for i in range(600)]
    events += [(600 + i, 46.0 + rng.gauss(0, 0.1), -2.0 + rng.gauss(0, 0.1)) for i in range(200)]
    raster = nearest.coast_raster(spark.createDataFrame(sites, SITE))
    frame = spark.createDataFrame(events, "event int, lat double, lon double")
    got = {r.event: (r.segment_id, r.distance_km) for r in nearest.snap_to_segment(frame, raster).collect()}
    for event, lat, lon in events:
        want = brute_snap(lat, lon, sites)
        if want is None:
            assert event not in got
        else:
            assert got[event][0] == want[1]
            assert got[event][1] == pytest.approx(want[0], abs=1e-9)


def test_equal_distances_go_to_the_lower_segment(spark):
    sites = spark.createDataFrame([(7, 46.02, -2.0), (3, 45.98, -2.0)], SITE)
    event = spark.createDataFrame([(1, 46.0, -2.0)], "event int, lat double, lon double")
    raster = nearest.coast_raster(sites)
    snapped = nearest.snap_to_segment(event, raster).first()
    d7 = abs(42 + 200 * 0.02 - 46.02) * 110.6
    d3 = abs(42 + 200 * 0.02 - 45.98) * 110.6
    assert snapped.segment_id == (3 if d3 <= d7 else 7)
    copies = spark.createDataFrame([(9, 46.02, -2.0), (4, 46.02, -2.0)], SITE)
    assert nearest.snap_to_segment(event, nearest.coast_raster(copies)).first().segment_id == 4


def test_events_outside_the_region_are_clipped_to_its_edge(spark):
    sites = spark.createDataFrame([(1, 42.0, -6.0)], SITE)
    event = spark.createDataFrame([(1, 30.0, -20.0)], "event int, lat double, lon double")
    row = nearest.snap_to_segment(event, nearest.coast_raster(sites)).first()
    assert (row.segment_id, row.distance_km) == (1, 0.0)


def test_nearest_within_finds_the_true_minimum(spark):
    rng = random.Random(5)
    sites = [(42 + rng.random() * 9, -6 + rng.random() * 15) for _ in range(30)]
    points = [(i, 42 + rng.random() * 9, -6 + rng.random() * 15) for i in range(150)]
    got = nearest.nearest_within(
        spark.createDataFrame(points, "id int, lat double, lon double"),
        spark.createDataFrame(sites, "lat double, lon double"),
        120.0,
    ).collect()
    assert len(got) == 150
    for row in got:
        best = min(haversine((row.lat, row.lon), s) for s in sites)
        if best > 120.0:
            assert row.distance_km is None
        else:
            assert row.distance_km == pytest.approx(best, abs=1e-6)


def test_nearest_within_is_exact_up_to_80_degrees_and_across_the_date_line(spark):
    rng = random.Random(9)
    sites = [(62.0, 4.2)] + [(rng.uniform(-82, 82), rng.choice([-1, 1]) * rng.uniform(160, 180)) for _ in range(150)]
    points = [(0, 62.0, 0.49), (1, 10.0, 180.0), (2, 10.0, -180.0)] + [
        (3 + i, rng.uniform(-80, 80), rng.choice([-1, 1]) * rng.uniform(165, 180)) for i in range(200)
    ]
    got = nearest.nearest_within(
        spark.createDataFrame(points, "id int, lat double, lon double"),
        spark.createDataFrame(sites, "lat double, lon double"),
        400.0,
    ).collect()
    assert len(got) == len(points)
    for row in got:
        best = min(haversine((row.lat, row.lon), s) for s in sites)
        if best > 400.0:
            assert row.distance_km is None
        else:
            assert row.distance_km == pytest.approx(best, abs=1e-6)
    assert next(r for r in got if r.id == 0).distance_km == pytest.approx(194, abs=2)


def test_kernel_weights_equal_the_dense_matrix(spark):
    rng = random.Random(1)
    segments = [(i, 43 + rng.random() * 7, -5 + rng.random() * 13) for i in range(40)] + [(40, 43.0, 30.0)]
    cells = [(42 + 0.25 * i, -6 + 0.25 * j) for i in range(0, 39, 2) for j in range(0, 63, 2)]
    frame = spark.createDataFrame(segments, "segment_id int, center_lat double, center_lon double")
    values = spark.createDataFrame(
        [(a, b, "2024-01-01", a + b) for a, b in cells], "lat double, lon double, day string, x double"
    )
    got = {r.segment_id: r.x for r in kernel.kernel_interpolate(frame, values, ["x"]).collect()}
    lat, lon = np.array([s[1] for s in segments]), np.array([s[2] for s in segments])
    cell = np.array(cells)
    scale = math.cos(math.radians(lat.mean()))
    d = np.hypot((lat[:, None] - cell[:, 0]) * 111.2, (lon[:, None] - cell[:, 1]) * 111.2 * scale)
    weight = np.where(d > 75.0, 0.0, np.exp(-0.5 * (d / 25.0) ** 2))
    for (segment, _, _), w in zip(segments, weight, strict=True):
        if w.sum() == 0:
            assert segment not in got
        else:
            assert got[segment] == pytest.approx(float(w @ cell.sum(axis=1) / w.sum()), abs=1e-9)
    assert 40 not in got


def brute_fill(plane, passes=6):
    filled = plane.copy()
    for _ in range(passes):
        before = filled.copy()
        for i in range(plane.shape[0]):
            for j in range(plane.shape[1]):
                if before[i, j] != 0.0:
                    continue
                near = [
                    before[a, b]
                    for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1))
                    if 0 <= a < plane.shape[0] and 0 <= b < plane.shape[1] and before[a, b] != 0.0
                ]
                if near:
                    filled[i, j] = sum(near) / len(near)
    return filled


def test_gap_filling_equals_brute_force(spark):
    rng = random.Random(2)
    entries, planes = [], {}
    for hour in ("a", "b"):
        plane = np.zeros((39, 63))
        for _ in range(60):
            i, j = rng.randrange(39), rng.randrange(63)
            plane[i, j] = rng.choice([-1.5, 0.0, 2.0, 4.0])
            entries.append((hour, i, j, float(plane[i, j])))
        planes[hour] = plane
    # a cell given twice keeps the larger value, so give each cell once
    entries = [(h, i, j, float(planes[h][i, j])) for h, i, j in {(h, i, j) for h, i, j, _ in entries}]
    frame = spark.createDataFrame(entries, "valid_at string, row_i int, col_j int, u double")
    got = {h: np.zeros((39, 63)) for h in planes}
    for r in lattice.fill_gaps(frame, "u").collect():
        got[r.valid_at][r.row_i, r.col_j] = r.u
    for hour, plane in planes.items():
        assert np.allclose(got[hour], brute_fill(plane), atol=1e-12)


def test_grid_has_every_cell(spark):
    cells = lattice.grid(spark)
    assert cells.count() == 39 * 63 == cells.distinct().count()
    low = cells.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert tuple(low) == (42.0, 51.5, -6.0, 9.5)


def test_select_grid_rules(spark):
    cells = spark.createDataFrame(
        [(1, 199.0, -5.0), (2, 201.0, -5.0), (3, 29.0, 50.0), (4, 31.0, 50.0), (5, 31.0, None), (6, 10.0, None)],
        "id int, distance_km double, elevation_m double",
    )
    assert sorted(r.id for r in lattice.select_grid(cells).collect()) == [1, 3, 6]


def test_coverage_extent_stops_at_the_first_gap(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), h >= 30) for h in range(48) if h != 40]
    frame = spark.createDataFrame(rows, "valid_at timestamp_ntz, forecast boolean")
    days = spark.sql("SELECT explode(array(date'2024-01-01', date'2024-01-02', date'2024-01-05')) AS release_day")
    got = {r.release_day.day: (r.hours, r.archived_hours, r.settled) for r in lattice.coverage_extent(frame, days).collect()}
    assert got == {1: (40, 30, "no"), 2: (16, 6, "no"), 5: (0, 0, "no")}


def walk(points, target=10.0):
    closed, current, length = [], [], 0.0
    for p in points:
        if current:
            length += haversine(current[-1], p)
        current.append(p)
        if length >= target:
            closed.append((current, length))
            current, length = [p], 0.0
    if len(current) > 1 and length >= target / 2:
        closed.append((current, length))
    return closed


def test_segmentation_equals_a_plain_walk(spark):
    rng = random.Random(9)
    lines = []
    for line in range(30):
        lat, lon, points = 45 + rng.random(), -3 + rng.random(), []
        for _ in range(rng.randrange(0, 60)):
            points.append((lat, lon))
            lat, lon = lat + rng.gauss(0, 0.02), lon + rng.gauss(0, 0.03)
        lines.append((line, points))
    frame = spark.createDataFrame(lines, "line_id int, points array<struct<lat: double, lon: double>>")
    got = sorted(
        (r.line_id, r.piece, r.length_km, len(r.path), r.center_lat) for r in shoreline.segment_lines(frame).collect()
    )
    want = [
        (line, piece, length, len(run), sum(p[0] for p in run) / len(run))
        for line, points in lines
        for piece, (run, length) in enumerate(walk(points))
    ]
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3]
        assert a[2] == pytest.approx(b[2]) and a[4] == pytest.approx(b[4])


def test_densified_line_keeps_its_points(spark):
    points = [(45.0, -2.0), (45.05, -2.0), (45.05, -2.0), (45.05, -1.9)]
    frame = spark.createDataFrame([(1, points), (2, [])], "line_id int, points array<struct<lat: double, lon: double>>")
    got = [(r.lat, r.lon) for r in shoreline.densify_line(frame).orderBy("leg", "step").collect()]
    want = [points[0]]
    for a, b in zip(points, points[1:]):
        span = haversine(a, b)
        for step in range(1, int(span / 2.0) + 1):
            share = step * 2.0 / span
            want.append((a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share))
        want.append(b)
    assert got == [pytest.approx(w) for w in want]


def wandering(rng, n, step):
    """A line of n points near the middle of the region, with legs of very different lengths."""
    lat, lon, out = 46.0, 1.0, []
    for _ in range(n):
        out.append((lat, lon))
        far = rng.choice([0.0, step, step, step * 40])
        lat = min(max(lat + rng.uniform(-far, far), 43.0), 50.0)
        lon = min(max(lon + rng.uniform(-far, far), -5.0), 9.0)
    return out


@pytest.mark.parametrize("block_points", [7, 40, 65_536])
def test_blocks_of_long_lines_are_cut_as_the_walk_cuts_them(spark, block_points):
    rng = random.Random(11)
    lines = [(0, wandering(rng, 900, 0.02)), (1, wandering(rng, 300, 0.0005)), (2, wandering(rng, 2, 0.5)), (3, [(46.0, 1.0)]),
             (4, [(46.0, 1.0)] * 30), (5, [(46.0, 1.0 + 0.3 * k) for k in range(12)]), (6, [(46.0, 1.0), (46.0, 1.1)])]
    frame = spark.createDataFrame([(i, [tuple(p) for p in points]) for i, points in lines],
                                  "line_id long, points array<struct<lat: double, lon: double>>")
    want = [(r.line_id, r.external_id, r.length_km, r.center_lat, r.center_lon, r.orientation_deg, [tuple(p) for p in r.path])
            for r in shoreline.segment_lines(frame).orderBy("line_id", "piece").collect()]
    # The order of the points need not be dense.
    points = longlines.points_of(frame).withColumn("seq", F.col("seq") * 3 + F.col("line_id")).repartition(5)
    got = [(r.line_id, r.external_id, r.length_km, r.center_lat, r.center_lon, r.orientation_deg, [tuple(p) for p in r.path])
           for r in longlines.segment_points(points, block_points=3 * block_points).orderBy("line_id", "start").collect()]
    assert len(want) > 60 and [(g[0], g[1], g[6]) for g in got] == [(w[0], w[1], w[6]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:6] == pytest.approx(w[2:6], rel=1e-12)
    dense = shoreline.densify_line(frame).select("line_id", (F.col("leg") * 3 + F.col("line_id")).alias("seq"), "step", "lat", "lon")
    mine = longlines.densify_points(points, block_points=3 * block_points)
    as_rows = lambda df: sorted((r.line_id, r.seq, r.step, round(r.lat, 9), round(r.lon, 9)) for r in df.collect())
    assert as_rows(mine) == as_rows(dense)


def test_no_points_no_pieces(spark):
    none = spark.createDataFrame([], "line_id long, seq long, lat double, lon double")
    assert longlines.segment_points(none).count() == 0 and longlines.densify_points(none).count() == 0


def test_a_changed_coastline_searches_its_own_nodes_only(spark, tmp_path):
    rng = random.Random(12)
    points = {s: [(43 + 8 * rng.random(), -5 + 13 * rng.random())] for s in range(40)}
    for s, own in points.items():
        own += [(own[0][0] + 0.02 * k, own[0][1] + 0.01 * k) for k in (1, 2)]

    def table(coast):
        rows = [(s, lat, lon) for s, own in coast.items() for lat, lon in own]
        return spark.createDataFrame(rows, "segment_id long, lat double, lon double")

    def content(raster):
        return {(r.node_row, r.node_col): (r.segment_id, r.distance_km) for r in raster.collect()}

    path, before = str(tmp_path / "rasters"), table(points)
    first = content(rasters.stored_raster(spark, path, before))
    assert first == content(nearest.coast_raster(before))
    changed = {s: own for s, own in points.items() if s != 3}  # one went, one moved, one came, next to others
    changed[5] = [(lat + 0.03, lon) for lat, lon in points[5]]
    changed[99] = [(points[7][0][0] + 0.01, points[7][0][1])]
    after = table(changed)
    updated, touched = rasters.updated_raster(nearest.coast_raster(before), before, after, 15.0)
    full = content(nearest.coast_raster(after))
    assert content(updated) == full
    searched = {(r.node_row, r.node_col) for r in touched.collect()}
    moved = [p for s in (3, 5) for p in points[s]] + [p for s in (5, 99) for p in changed[s]]
    for row, column in searched:
        lat, lon = 42 + 0.02 * row, -6 + 0.02 * column
        assert min(max(abs(lat - p[0]) * 110.6, abs(lon - p[1]) * 111.3 * math.cos(math.radians(p[0]))) for p in moved) < 15 + 3
    assert {n for n in {*first, *full} if first.get(n) != full.get(n)} <= searched and len(searched) < len(first) / 3
    assert content(rasters.stored_raster(spark, path, after)) == full
    names = rasters._versions(spark, path)
    assert content(rasters.stored_raster(spark, path, before.repartition(7))) == first  # another order, the same content
    assert rasters._versions(spark, path) == names and len(names) == 2
    for n in range(4):
        rasters.stored_raster(spark, path, table({n: points[n]}))
    assert len(rasters._versions(spark, path)) == 3
    assert content(rasters.stored_raster(spark, path, table({}).limit(0))) == {}


def test_points_meet_the_sites_of_their_cell_in_one_row(spark):
    """Dense sites, more than one chunk of them in a cell; points are not multiplied by tiles or sites."""
    rng = np.random.default_rng(5)
    sites = np.concatenate([[45.0, 3.0] + rng.random((3000, 2)) * 0.0005, [42.0, -6.0] + rng.random((300, 2)) * [9.0, 15.0]])
    places = np.concatenate([[45.0, 3.0] + rng.random((40, 2)) * 0.019, [42.0, -6.0] + rng.random((160, 2)) * [9.0, 15.0]])
    found = nearest.nearest_within(
        spark.createDataFrame([tuple(map(float, p)) for p in places], "lat double, lon double"),
        spark.createDataFrame([tuple(map(float, s)) for s in sites], "lat double, lon double"),
        40.0,
    )
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.lat, r.lon): r.distance_km for r in found.collect()}
    for lat, lon in places:
        a, b, c, d = map(np.radians, (lat, lon, sites[:, 0], sites[:, 1]))
        chord = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        true = float(2 * 6371.0088 * np.arcsin(np.sqrt(chord.min())))
        assert got[lat, lon] == (pytest.approx(true, abs=1e-7) if true <= 40.0 else None)


def test_raster_nodes_meet_only_the_sites_left_to_them(spark):
    """A dense coast: nodes of a tile are not paired with all sites of the tiles around."""
    rng = np.random.default_rng(6)
    sites = [(n, 45.0 + float(a) * 0.1, 3.0 + float(b) * 0.1) for n, (a, b) in enumerate(rng.random((2000, 2)))]
    raster = nearest.coast_raster(spark.createDataFrame(sites, "segment_id long, lat double, lon double"), 15.0)
    assert "Generate" not in raster._jdf.queryExecution().executedPlan().toString()
    rows = raster.where("node_row % 5 = 0 AND node_col % 5 = 0").collect()
    assert rows
    lat, lon = np.array([s[1] for s in sites]), np.array([s[2] for s in sites])
    for row in rows:
        at = 42.0 + row.node_row * 0.02, -6.0 + row.node_col * 0.02
        km = np.hypot((at[0] - lat) * 110.6, (at[1] - lon) * 111.3 * np.cos(np.radians(lat)))
        assert row.segment_id == int(km.argmin()) and row.distance_km == pytest.approx(float(km.min()), abs=1e-9)


def test_blocks_hold_points_however_sparse_their_places_are(spark):
    """Points far apart in `seq` share blocks, and points are not sorted where they are read."""
    rows = [(1, 97 * n, 45.0 + (n % 7) * 0.01, 3.0 + n * 0.01) for n in range(400)]
    points = spark.createDataFrame(rows, "line_id long, seq long, lat double, lon double")
    legs = longlines.legs(points, block_points=32)
    assert "SortAggregate" not in legs._jdf.queryExecution().executedPlan().toString()
    got = legs.orderBy("seq").collect()
    assert [(r.seq, r["from"] and (r["from"].lat, r["from"].lon)) for r in got] == [
        (row[1], rows[n - 1][2:] if n else None) for n, row in enumerate(rows)
    ]
    blocks = [r.block for r in got]
    assert blocks == sorted(blocks) and len(set(blocks)) <= 400 // 32 + 1
    assert max(blocks.count(b) for b in set(blocks)) < 64


def test_lines_are_made_by_many_tasks(spark, small):
    from tidewrack.catalog import inputs

    # The table is one small file: without dealing it out, one task made and walked all lines.
    assert inputs.lines(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
