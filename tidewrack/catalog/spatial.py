"""Spatial joins, kernels, lattices and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.registry import query
from tidewrack.constants import COAST_LIMIT_KM, SNAP_RADIUS_KM
from tidewrack.operators import kernel, lattice, longlines, nearest, sea, shoreline
from tidewrack.sources.rasters import updated_raster


@query(
    "j2_snap_to_segment",
    "SELECT external_id, segment_id, round(distance_km, 6) AS distance_km FROM fx_snapped",
)
def snapped(spark, folder):
    return nearest.snap_to_segment(
        inputs.strandings(spark, folder), nearest.coast_raster(inputs.segment_points(spark, folder))
    ).select("external_id", "segment_id", r6("distance_km"))


@query(
    "j2_snap_updated",
    "SELECT external_id, segment_id, round(distance_km, 6) AS distance_km FROM fx_snapped",
)
def snapped_after_update(spark, folder):
    """Snapping on a raster brought up to date after every third segment was added or moved."""
    after = inputs.segment_points(spark, folder)
    place = F.col("segment_id") % 3
    before = after.where(place > 0).withColumn("lat", F.when(place == 1, F.col("lat") + 0.05).otherwise(F.col("lat")))
    raster, _ = updated_raster(nearest.coast_raster(before), before, after, SNAP_RADIUS_KM)
    return nearest.snap_to_segment(inputs.strandings(spark, folder), raster).select(
        "external_id", "segment_id", r6("distance_km")
    )


@query(
    "j2_observed_history",
    "SELECT segment_id, day, records FROM fx_observed",
)
def observed(spark, folder):
    return nearest.observed_strandings(
        inputs.strandings(spark, folder), nearest.coast_raster(inputs.segment_points(spark, folder))
    )


GRID_SQL = """(SELECT 42e0 + i * 0.25e0 AS lat, -6e0 + j * 0.25e0 AS lon
  FROM (SELECT unnest(range(39)) AS i), (SELECT unnest(range(63)) AS j))"""
HAVERSINE = """6371.0088e0 * 2 * asin(least(1, sqrt(power(sin(radians({0}.lat - {1}.lat) / 2), 2)
  + cos(radians({1}.lat)) * cos(radians({0}.lat)) * power(sin(radians({0}.lon - {1}.lon) / 2), 2))))"""


@query(
    "j3_nearest_within",
    f"""SELECT g.lat, g.lon, round(CASE WHEN d <= 200 THEN d END, 6) AS distance_km
        FROM (SELECT g.lat, g.lon, min({HAVERSINE.format('p', 'g')}) AS d
              FROM {GRID_SQL} g, fx_segment_point p GROUP BY 1, 2) g""",
)
def grid_distance(spark, folder):
    return nearest.nearest_within(
        lattice.grid(spark), inputs.segment_points(spark, folder), COAST_LIMIT_KM
    ).select("lat", "lon", r6("distance_km"))


@query(
    "j3_nearest_events",
    f"""SELECT s.external_id, round(CASE WHEN d <= 40 THEN d END, 6) AS distance_km
        FROM (SELECT s.external_id, min({HAVERSINE.format('p', 's')}) AS d
              FROM fx_stranding s, fx_segment p_, (SELECT 1) x,
                   LATERAL (SELECT p_.center_lat AS lat, p_.center_lon AS lon) p GROUP BY 1) s""",
)
def event_distance(spark, folder):
    """Every stranding to its nearest segment centre, by great circle."""
    centers = inputs.segments(spark, folder).select(
        F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")
    )
    events = inputs.strandings(spark, folder).select("external_id", "lat", "lon")
    return nearest.nearest_within(events, centers, 40.0).select(
        "external_id", r6("distance_km")
    )


@query(
    "p3_p4_select_grid",
    f"""SELECT g.lat, g.lon, round(d, 6) AS distance_km, round(elevation_m, 6) AS elevation_m
        FROM (SELECT g.lat, g.lon, min({HAVERSINE.format('p', 'g')}) AS d
              FROM {GRID_SQL} g, fx_segment_point p GROUP BY 1, 2) g
        LEFT JOIN (SELECT lat, lon, round(2 - avg(wave_height_m), 6) AS elevation_m FROM fx_condition GROUP BY 1, 2) e
          USING (lat, lon)
        WHERE d <= 200 AND (coalesce(elevation_m, 0) < 0 OR d <= 30)""",
)
def sampled_grid(spark, folder):
    """The lattice cells worth sampling; heights come from the mean waves of the test data."""
    height = (
        inputs.condition(spark, folder)
        .groupBy("lat", "lon")
        .agg((F.round(F.lit(2.0) - F.avg("wave_height_m"), 6)).alias("elevation_m"))
    )
    measured = nearest.nearest_within(
        lattice.grid(spark), inputs.segment_points(spark, folder), COAST_LIMIT_KM
    ).join(height, ["lat", "lon"], "left")
    return lattice.select_grid(measured).select("lat", "lon", r6("distance_km"), r6("elevation_m"))


@query(
    "t4_ordered_grid",
    f"""SELECT cast(row_number() OVER (ORDER BY lat, lon) AS int) AS place, lat, lon, cells
        FROM (SELECT lat, lon, count(*) AS cells FROM fx_condition GROUP BY 1, 2)""",
)
def ordered_grid(spark, folder):
    """Sampled cells in (lat, lon) order, with their place in it."""
    from tidewrack.operators.ranking import ordinal_rank

    cells = inputs.condition(spark, folder).groupBy("lat", "lon").agg(F.count("*").alias("cells"))
    return ordinal_rank(cells, ["lat", "lon"], "place").select(
        F.col("place").cast("int").alias("place"), "lat", "lon", "cells"
    )


@query(
    "j4_kernel_interpolate",
    """SELECT segment_id, day, round(swell_m, 6) AS swell_m, round(wave_m, 6) AS wave_m,
         round(period_s, 6) AS period_s, round(east_m, 6) AS east_m, round(north_m, 6) AS north_m
       FROM fx_kernel""",
)
def interpolated(spark, folder):
    daily = sea.daily_sea_state(inputs.condition(spark, folder))
    return kernel.kernel_interpolate(
        inputs.segments(spark, folder), daily, sea.SEA_VALUES
    ).select("segment_id", "day", *(r6(n) for n in sea.SEA_VALUES))


@query(
    "j8_densify_on_segments",
    """SELECT s.segment_id, round(coalesce(v, 0), 6) AS drift_index FROM fx_segment s
       LEFT JOIN (SELECT coastal_segment_id, sum(drift_index) AS v FROM fx_drift_daily GROUP BY 1) d
         ON d.coastal_segment_id = s.segment_id""",
)
def dense(spark, folder):
    landed = (
        inputs.drift_daily(spark, folder)
        .groupBy(F.col("coastal_segment_id").alias("segment_id"))
        .agg(F.sum("drift_index").alias("drift_index"))
    )
    return sea.densify_on_segments(
        inputs.segments(spark, folder), landed, "drift_index"
    ).select("segment_id", r6("drift_index"))


FIELD = """(SELECT valid_at, cast(round_even((lat - 42e0) / 0.25e0, 0) AS int) AS row_i,
   cast(round_even((lon + 6e0) / 0.25e0, 0) AS int) AS col_j,
   coalesce(current_speed_kmh, 0) / 3.6e0 * sin(radians(coalesce(current_direction_deg, 0))) AS current_u,
   coalesce(wave_height_m, 0) AS wave_m, sea_level_m FROM fx_condition)"""


def _points(spark, folder):
    return inputs.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.expr(
            "timestampadd(HOUR, cast(l_partkey % 720 AS int), timestamp_ntz'2001-06-01 00:00:00')"
        ).alias("valid_at"),
        F.expr("41.9e0 + (l_orderkey * 7 % 9700) / 1000e0").alias("lat"),
        F.expr("-6.1e0 + (l_partkey * 13 % 15700) / 1000e0").alias("lon"),
    ).distinct()


@query(
    "j9_sample_field",
    f"""WITH pts AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey,
            timestamp '2001-06-01 00:00:00' + to_hours(cast(l_partkey % 720 AS int)) AS valid_at,
            (41.9e0 + (l_orderkey * 7 % 9700) / 1000e0 - 42e0) / 0.25e0 AS r,
            (-6.1e0 + (l_partkey * 13 % 15700) / 1000e0 + 6e0) / 0.25e0 AS c FROM lineitem),
          based AS (SELECT *, cast(greatest(least(floor(r), 37), 0) AS int) AS r0,
            cast(greatest(least(floor(c), 61), 0) AS int) AS c0 FROM pts),
          frac AS (SELECT *, greatest(least(r - r0, 1), 0) AS fr, greatest(least(c - c0, 1), 0) AS fc FROM based),
          field AS {FIELD},
          corner AS (SELECT *, r0 AS row_i, c0 AS col_j, (1 - fr) * (1 - fc) AS share FROM frac
            UNION ALL SELECT *, r0, c0 + 1, (1 - fr) * fc FROM frac
            UNION ALL SELECT *, r0 + 1, c0, fr * (1 - fc) FROM frac
            UNION ALL SELECT *, r0 + 1, c0 + 1, fr * fc FROM frac)
        SELECT l_orderkey, l_linenumber, l_partkey,
          round(sum(share * coalesce(current_u, 0)), 6) AS current_u,
          round(sum(share * coalesce(wave_m, 0)), 6) AS wave_m
        FROM corner LEFT JOIN field USING (valid_at, row_i, col_j) GROUP BY 1, 2, 3""",
)
def sampled(spark, folder):
    """Fields at one moving point per line item."""
    field = lattice.forcing_fields(inputs.condition(spark, folder))
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return lattice.sample_field(_points(spark, folder), field, ["current_u", "wave_m"]).select(*key, r6("current_u"), r6("wave_m"))


# Means of tenths often end exactly half-way at the sixth decimal.
TIE_NUDGE = 3e-9


def _filled(n: int) -> str:
    """Pass n over the planes: holes take the mean of the non-zero cells beside them."""
    beside = " UNION ALL ".join(
        f"SELECT valid_at, row_i + {i} AS row_i, col_j + {j} AS col_j, v FROM p{n - 1} WHERE v <> 0"
        for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))
    )
    return f"""p{n} AS MATERIALIZED (
        SELECT p.valid_at, p.row_i, p.col_j, CASE WHEN p.v <> 0 THEN p.v ELSE coalesce(m, 0) END AS v
        FROM p{n - 1} p LEFT JOIN (SELECT valid_at, row_i, col_j, avg(v) AS m FROM ({beside})
                                   GROUP BY 1, 2, 3) b USING (valid_at, row_i, col_j))"""


@query(
    "w5_fill_gaps",
    f"""WITH p0 AS (SELECT h.valid_at, i AS row_i, j AS col_j, coalesce(wave_m, 0) AS v
            FROM (SELECT DISTINCT valid_at FROM fx_condition) h, (SELECT unnest(range(39)) AS i),
                 (SELECT unnest(range(63)) AS j)
            LEFT JOIN {FIELD} f ON f.valid_at = h.valid_at AND f.row_i = i AND f.col_j = j),
          {", ".join(_filled(n) for n in range(1, 7))}
        SELECT valid_at, cast(row_i AS int) AS row_i, cast(col_j AS int) AS col_j, round(v + 3e-9, 6) AS wave_m FROM p6""",
)
def filled(spark, folder):
    field = lattice.forcing_fields(inputs.condition(spark, folder))
    return lattice.fill_gaps(field, "wave_m").select(
        "valid_at", "row_i", "col_j", r6("wave_m", F.col("wave_m") + TIE_NUDGE)
    )


@query(
    "a18_standardise",
    f"""WITH field AS {FIELD},
          stats AS (SELECT row_i, col_j, avg(sea_level_m) AS m, stddev_pop(sea_level_m) AS s FROM field GROUP BY 1, 2)
        SELECT valid_at, row_i, col_j, round(CASE WHEN sea_level_m IS NULL THEN 0
          ELSE greatest(least((sea_level_m - m) / CASE WHEN s > 1e-6 THEN s ELSE 1 END, 2), -2) END, 6) AS sea_level_m
        FROM field JOIN stats USING (row_i, col_j)""",
)
def tide(spark, folder):
    field = lattice.forcing_fields(inputs.condition(spark, folder))
    return lattice.standardise(field, "sea_level_m").select(
        "valid_at", "row_i", "col_j", r6("sea_level_m")
    )


@query(
    "a17_coverage_extent",
    """WITH hours AS (SELECT valid_at, bool_or(NOT forecast) AS archived FROM fx_condition GROUP BY 1),
         days AS (SELECT DISTINCT cast(valid_at AS date) AS release_day FROM fx_condition),
         wanted AS (SELECT release_day, h, cast(release_day AS timestamp) + to_hours(cast(h AS int)) AS valid_at
           FROM days, (SELECT unnest(range(480)) AS h))
       SELECT release_day,
         cast(coalesce(min(CASE WHEN archived IS NULL THEN h END), 480) AS int) AS hours,
         cast(coalesce(min(CASE WHEN NOT coalesce(archived, false) THEN h END), 480) AS int) AS archived_hours,
         CASE WHEN min(CASE WHEN NOT coalesce(archived, false) THEN h END) IS NULL THEN 'yes' ELSE 'no' END AS settled
       FROM wanted LEFT JOIN hours USING (valid_at) GROUP BY 1""",
)
def extent(spark, folder):
    condition = inputs.condition(spark, folder)
    days = condition.select(F.to_date("valid_at").alias("release_day")).distinct()
    return lattice.coverage_extent(condition, days)


LEG = """CASE WHEN a.lat IS NULL THEN 0 ELSE 6371.0088e0 * 2 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) END"""


@query(
    "w7_segment_lines",
    f"""WITH RECURSIVE leg AS (SELECT b.line_id, b.seq, coalesce({LEG}, 0) AS km
            FROM fx_line_point b LEFT JOIN fx_line_point a ON a.line_id = b.line_id AND a.seq = b.seq - 1),
          walk(line_id, seq, start, length, closed) AS (
            SELECT line_id, seq, cast(0 AS bigint), 0e0, false FROM leg WHERE seq = 0
            UNION ALL
            SELECT l.line_id, l.seq, CASE WHEN w.closed THEN w.seq ELSE w.start END,
              CASE WHEN w.closed THEN 0 ELSE w.length END + l.km,
              CASE WHEN w.closed THEN 0 ELSE w.length END + l.km >= 10
            FROM walk w JOIN leg l ON l.line_id = w.line_id AND l.seq = w.seq + 1),
          piece AS (SELECT line_id, start, seq AS stop, length FROM walk
            WHERE closed OR (seq = 39 AND length >= 5 AND start < seq)),
          shaped AS (SELECT p.line_id, p.start, p.length, avg(q.lat) AS center_lat, avg(q.lon) AS center_lon,
              count(*) AS points, arg_min(q.lat, q.seq) AS a_lat, arg_min(q.lon, q.seq) AS a_lon,
              arg_max(q.lat, q.seq) AS b_lat, arg_max(q.lon, q.seq) AS b_lon
            FROM piece p JOIN fx_line_point q ON q.line_id = p.line_id AND q.seq BETWEEN p.start AND p.stop
            GROUP BY p.line_id, p.start, p.stop, p.length)
        SELECT line_id, substring(sha256(concat(printf('%.5f', a_lon), ',', printf('%.5f', a_lat), '|',
             printf('%.5f', b_lon), ',', printf('%.5f', b_lat))), 1, 32) AS external_id,
          round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon,
          round(length, 6) AS length_km, cast(points AS int) AS points,
          round((degrees(atan2(cos(radians((a_lat + b_lat) / 2)) * (b_lon - a_lon), b_lat - a_lat)) + 360e0) % 360e0, 6)
            AS orientation_deg
        FROM shaped WHERE center_lat BETWEEN 42 AND 51.5 AND center_lon BETWEEN -6 AND 9.5""",
)
def cut_lines(spark, folder):
    return shoreline.segment_lines(inputs.lines(spark, folder)).select(
        "line_id", "external_id", r6("center_lat"), r6("center_lon"), r6("length_km"),
        F.size("path").alias("points"), r6("orientation_deg"),
    )


@query(
    "w9_densify_line",
    f"""WITH leg AS (SELECT b.line_id, b.seq, coalesce(a.lat, b.lat) AS a_lat, coalesce(a.lon, b.lon) AS a_lon,
            b.lat, b.lon, coalesce({LEG}, 0) AS km
            FROM fx_line_point b LEFT JOIN fx_line_point a ON a.line_id = b.line_id AND a.seq = b.seq - 1)
        SELECT line_id, cast(seq AS int) AS leg, cast(step AS int) AS step,
          round(CASE WHEN step > floor(km / 2) THEN lat ELSE a_lat + (lat - a_lat) * step * 2 / km END, 6) AS lat,
          round(CASE WHEN step > floor(km / 2) THEN lon ELSE a_lon + (lon - a_lon) * step * 2 / km END, 6) AS lon
        FROM (SELECT *, unnest(range(1, cast(floor(km / 2) AS int) + 2)) AS step FROM leg)""",
)
def densified(spark, folder):
    return shoreline.densify_line(inputs.lines(spark, folder)).select(
        "line_id", "leg", "step", r6("lat"), r6("lon")
    )


def coast_points(spark, folder):
    """One long line per nation: the lines of its customers one after the other."""
    points = longlines.points_of(inputs.lines(spark, folder))
    nations = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("line_id"), F.col("c_nationkey").cast("long").alias("nation"))
    return points.join(nations, "line_id").select(
        F.col("nation").alias("line_id"), (F.col("line_id") * inputs.LINE_POINTS + F.col("seq")).alias("seq"), "lat", "lon"
    )


COAST = """coast AS (SELECT cast(c_nationkey AS bigint) AS line_id, line_id * 40 + seq AS place, lat, lon,
            row_number() OVER (PARTITION BY c_nationkey ORDER BY line_id, seq) - 1 AS seq
          FROM fx_line_point JOIN customer ON c_custkey = line_id),
        leg AS (SELECT b.line_id, b.seq, b.place, b.lat, b.lon, coalesce(a.lat, b.lat) AS a_lat, coalesce(a.lon, b.lon) AS a_lon,
            coalesce({leg}, 0) AS km
          FROM coast b LEFT JOIN coast a ON a.line_id = b.line_id AND a.seq = b.seq - 1)""".format(leg=LEG)


@query(
    "w7_long_lines",
    f"""WITH RECURSIVE {COAST}, ends AS (SELECT line_id, max(seq) AS last FROM coast GROUP BY 1),
          walk(line_id, seq, start, length, closed) AS (
            SELECT line_id, seq, cast(0 AS bigint), 0e0, false FROM leg WHERE seq = 0
            UNION ALL
            SELECT l.line_id, l.seq, CASE WHEN w.closed THEN w.seq ELSE w.start END,
              CASE WHEN w.closed THEN 0 ELSE w.length END + l.km,
              CASE WHEN w.closed THEN 0 ELSE w.length END + l.km >= 10
            FROM walk w JOIN leg l ON l.line_id = w.line_id AND l.seq = w.seq + 1),
          piece AS (SELECT line_id, start, seq AS stop, length FROM walk JOIN ends USING (line_id)
            WHERE closed OR (seq = last AND length >= 5 AND start < seq)),
          shaped AS (SELECT p.line_id, arg_min(q.place, q.seq) AS start, p.length, avg(q.lat) AS center_lat,
              avg(q.lon) AS center_lon, count(*) AS points
            FROM piece p JOIN coast q ON q.line_id = p.line_id AND q.seq BETWEEN p.start AND p.stop
            GROUP BY p.line_id, p.start, p.stop, p.length)
        SELECT line_id, start, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon,
          round(length, 6) AS length_km, cast(points AS int) AS points
        FROM shaped WHERE center_lat BETWEEN 42 AND 51.5 AND center_lon BETWEEN -6 AND 9.5""",
)
def cut_long_lines(spark, folder):
    """Lines far longer than a block, cut by the tasks of all their blocks."""
    return longlines.segment_points(coast_points(spark, folder), block_points=4096).select(
        "line_id", "start", r6("center_lat"), r6("center_lon"), r6("length_km"), F.size("path").alias("points")
    )


@query(
    "w9_densify_points",
    f"""WITH {COAST}
        SELECT line_id, place AS seq, cast(step AS int) AS step,
          round(CASE WHEN step > floor(km / 25) THEN lat ELSE a_lat + (lat - a_lat) * step * 25 / km END, 6) AS lat,
          round(CASE WHEN step > floor(km / 25) THEN lon ELSE a_lon + (lon - a_lon) * step * 25 / km END, 6) AS lon
        FROM (SELECT *, unnest(range(1, cast(floor(km / 25) AS int) + 2)) AS step FROM leg)""",
)
def densified_points(spark, folder):
    """A point every 25 km of lines far longer than a block."""
    return longlines.densify_points(coast_points(spark, folder), spacing_km=25.0, block_points=4096).select(
        "line_id", "seq", "step", r6("lat"), r6("lon")
    )
