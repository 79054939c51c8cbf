"""History and daily sea-state queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.registry import query
from tidewrack.operators import history, sea
from tidewrack.operators.nearest import observed_strandings
from tidewrack.plans.risk import slots_between
from tidewrack.session import new_folder, settled, shared_folder
from tidewrack.sources.masses import daily_persistence
from tidewrack.sources.rasters import stored_raster

# The days on which the stored mass is brought up to date.
UPDATES = ("1997-03-01", "1997-03-08")


def raster(spark, folder):
    """The raster of the folder's coastline, kept beside the session's checkpoints."""
    return stored_raster(spark, f"{shared_folder(spark)}/coast-raster", inputs.segment_points(spark, folder))


def observed(spark, folder):
    return observed_strandings(inputs.strandings(spark, folder), raster(spark, folder))


def order_days(spark, folder):
    """Every day from the first to the last order."""
    edges = inputs.table(spark, folder, "orders").agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")
    )
    return edges.select(F.explode(F.sequence("a", "b")).alias("day"))


def spine(spark, folder):
    days = order_days(spark, folder).agg(F.collect_list("day").alias("days")).scalar()
    segments = inputs.segments(spark, folder).withColumn("days", days)
    return segments.select("segment_id", F.explode("days").alias("day"))


@query(
    "a4_daily_sea_state",
    """SELECT day, lat, lon, round(swell_m, 6) AS swell_m, round(wave_m, 6) AS wave_m,
         round(period_s, 6) AS period_s, round(east_m, 6) AS east_m, round(north_m, 6) AS north_m FROM fx_sea""",
)
def daily(spark, folder):
    return sea.daily_sea_state(inputs.condition(spark, folder)).select(
        "day", "lat", "lon", *(r6(n) for n in sea.SEA_VALUES)
    )


@query(
    "a5_drift_recent",
    """SELECT coastal_segment_id AS segment_id, day + cast(o AS int) AS day, round(sum(drift_index), 6) AS drift_index
       FROM fx_drift_daily, (SELECT unnest(range(4)) AS o) GROUP BY 1, 2""",
)
def recent(spark, folder):
    return sea.drift_recent(inputs.drift_daily(spark, folder)).select(
        "segment_id", "day", r6("drift_index")
    )


@query(
    "a6_persistence",
    """SELECT s.segment_id, s.day,
         round(coalesce(sum(o.records * power(0.5e0, ((s.day - 3) - o.day) / 365e0)), 0), 6) AS persistence
       FROM (SELECT segment_id, day FROM fx_segment, fx_order_day) s
       LEFT JOIN fx_observed o ON o.segment_id = s.segment_id AND o.day < s.day - 3 GROUP BY 1, 2""",
)
def decayed(spark, folder):
    """All days in one pass."""
    return history.persistence(observed(spark, folder), spine(spark, folder)).select(
        "segment_id", "day", r6("persistence")
    )


@query(
    "a6_daily_updates",
    f"""SELECT s.segment_id, s.day,
         round(coalesce(sum(o.records * power(0.5e0, ((s.day - 3) - o.day) / 365e0)), 0), 6) AS persistence
       FROM (SELECT segment_id, cast(unnest(generate_series(date '{UPDATES[0]}', date '{UPDATES[1]}', INTERVAL 1 DAY)) AS date)
               AS day FROM fx_segment) s
       LEFT JOIN fx_observed o ON o.segment_id = s.segment_id AND o.day < s.day - 3 GROUP BY 1, 2""",
)
def updated_daily(spark, folder):
    """One update a day: each reads the stored mass of the day before and the records since."""
    path, records = new_folder(spark, "mass"), settled(observed(spark, folder))
    first, last = map(date.fromisoformat, UPDATES)
    segments, done = inputs.segments(spark, folder), None
    for n in range((last - first).days + 1):
        rows = daily_persistence(spark, path, records, segments, first + timedelta(days=n))
        done = rows if done is None else done.unionByName(rows)
    return done.select("segment_id", "day", r6("persistence"))


@query(
    "a16_climatology_counts",
    """SELECT segment_id, cast(year AS int) AS year, cast(slot AS int) AS slot, cast(records AS bigint) AS records
       FROM fx_slotted""",
)
def slotted(spark, folder):
    return history.climatology_counts(observed(spark, folder))


@query(
    "w1_circular_window_sum",
    """SELECT segment_id, cast(year AS int) AS year, cast(slot AS int) AS slot, cast(records AS bigint) AS records
       FROM fx_windowed""",
)
def windowed(spark, folder):
    return history.circular_window_sum(history.climatology_counts(observed(spark, folder)))


def _leave_out(spark, folder):
    counted = observed(spark, folder)
    calendar = order_days(spark, folder)
    counts, slots = history.climatology_counts(counted), slots_between(calendar)
    sums = history.circular_window_sum(counts, slots)
    return counted, history.leave_one_year_out(sums, calendar, history.all_years_sum(counts, slots))


@query(
    "w2_leave_one_year_out",
    """SELECT segment_id, day, cast(records AS bigint) AS records FROM fx_long_seasonal WHERE records > 0""",
)
def held_out(spark, folder):
    return _leave_out(spark, folder)[1]


@query(
    "m2_seasonal",
    "SELECT segment_id, day, round(seasonal, 6) AS seasonal FROM fx_long_seasonal",
)
def seasonal(spark, folder):
    counted, sums = _leave_out(spark, folder)
    return history.with_seasonal(spine(spark, folder), sums, counted).select(
        "segment_id", "day", r6("seasonal")
    )


@query(
    "a20_seasonal_baseline",
    """WITH total AS (SELECT segment_id, slot, sum(records) AS n FROM fx_windowed GROUP BY 1, 2),
         dense AS (SELECT s.segment_id, k AS slot, coalesce(n, 0) AS n
                   FROM fx_segment s CROSS JOIN (SELECT unnest(range(366)) AS k)
                   LEFT JOIN total t ON t.segment_id = s.segment_id AND t.slot = k),
         chance AS (SELECT 1e0 - exp(-(n + 0.5e0) / (greatest((SELECT count(*) FROM fx_year), 1) * 31e0)) AS p FROM dense)
       SELECT round(avg(ln(p / (1 - p))), 6) AS seasonal_baseline FROM chance""",
)
def baseline(spark, folder):
    return history.seasonal_baseline(
        observed(spark, folder), inputs.segments(spark, folder)
    ).select(r6("seasonal_baseline"))
