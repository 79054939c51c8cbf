"""Effort, roster and species queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewrack.catalog import inputs
from tidewrack.catalog.expressions import r6
from tidewrack.catalog.registry import query
from tidewrack.constants import GFW_FISHING
from tidewrack.operators import effort, species


def _effort_cells(spark, folder):
    return inputs.vessels(spark, folder).filter(F.col("source") == GFW_FISHING)


@query(
    "a1_collapse_cells",
    """SELECT mmsi, recorded_at, round(lat, 6) AS lat, round(lon, 6) AS lon, gear_type, ship_name,
         round(total, 6) AS effort_hours
       FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, recorded_at
                 ORDER BY coalesce(effort_hours, 0) DESC, ordinal) AS n,
                 sum(coalesce(effort_hours, 0)) OVER (PARTITION BY mmsi, recorded_at) AS total
             FROM fx_vessel WHERE source = 'gfw_fishing') WHERE n = 1""",
)
def vessel_hours(spark, folder):
    return effort.collapse_cells(_effort_cells(spark, folder)).select(
        "mmsi", "recorded_at", r6("lat"), r6("lon"), "gear_type", "ship_name", r6("effort_hours")
    )


SEEDS = """(SELECT day, hour, lat, lon, effort * season * 0.31e0 AS weight FROM (
  SELECT cast(recorded_at AS date) AS day, hour(recorded_at) AS hour, round(lat, 3) AS lat,
    round(lon, 3) AS lon,
    sum(effort_hours * CASE lower(trim(gear_type)) WHEN 'trawlers' THEN 1e0 WHEN 'set_gillnets' THEN 1e0
      WHEN 'seiners' THEN 0.2e0 ELSE 0.3e0 END) AS effort,
    CASE month(any_value(recorded_at)) WHEN 1 THEN 1e0 WHEN 2 THEN 1e0 WHEN 3 THEN 0.9e0 ELSE 0.5e0 END AS season
  FROM fx_vessel WHERE effort_hours > 0 GROUP BY 1, 2, 3, 4) WHERE effort * season * 0.31e0 > 1e-9)"""


@query(
    "a2_release_seeds",
    f"""SELECT day, cast(hour AS int) AS hour, lat, lon, round(weight, 9) AS weight FROM {SEEDS}""",
)
def seeds(spark, folder):
    return effort.release_seeds(inputs.vessels(spark, folder)).select(
        "day", "hour", "lat", "lon", F.round("weight", 9).alias("weight")
    )


def _arrivals(spark, folder):
    return inputs.table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("release_day"),
        F.expr("cast(l_partkey % 480 AS int)").alias("hour"),
        F.col("l_suppkey").alias("segment_id"),
        F.expr("l_quantity / 1000e0").alias("drift_index"),
    )


@query(
    "a3_arrival_rollup",
    """SELECT cast(l_shipdate AS date) AS release_day,
         cast(l_shipdate AS date) + cast(floor(l_partkey % 480 / 24e0) AS int) AS day,
         l_suppkey AS coastal_segment_id, round(sum(l_quantity / 1000e0), 6) AS drift_index
       FROM lineitem GROUP BY 1, 2, 3""",
)
def arrivals(spark, folder):
    return effort.arrival_rollup(_arrivals(spark, folder)).select(
        "release_day", "day", "coastal_segment_id", r6("drift_index")
    )


@query(
    "a21_mass_balance",
    f"""WITH released AS (SELECT day AS release_day, sum(weight) AS released FROM {SEEDS} GROUP BY 1),
          stranded AS (SELECT release_day + 8400 AS release_day, sum(drift_index) AS stranded, count(*) AS segment_days
             FROM fx_drift_daily GROUP BY 1)
        SELECT release_day, round(released, 9) AS released, round(coalesce(stranded, 0), 6) AS stranded,
          coalesce(segment_days, 0) AS segment_days
        FROM released LEFT JOIN stranded USING (release_day)""",
)
def balance(spark, folder):
    # The two test tables cover different years; move landings into the effort's month.
    drift = inputs.drift_daily(spark, folder).withColumn(
        "release_day", F.date_add("release_day", 8400)
    )
    seeded = effort.release_seeds(inputs.vessels(spark, folder))
    return effort.mass_balance(seeded, drift).select(
        "release_day", F.round("released", 9).alias("released"), r6("stranded"), "segment_days"
    )


@query("w3_last_known", "SELECT mmsi, flag, gear_type, ship_name FROM fx_roster")
def roster(spark, folder):
    return effort.last_known(inputs.vessels(spark, folder)).select(
        "mmsi", "flag", "gear_type", "ship_name"
    )


# A handful of labels that hit every rule, spread over the parts.
LABELS = (
    "Dauphin commun", " Marsouin  commun ", "Grand dauphin, Dauphin commun", "Baleine inconnue",
    "Phoque gris", "Cachalot",
)


def _label_array(quote: str = "'") -> str:
    return ", ".join(f"'{x}'" for x in LABELS)


@query(
    "j1_species_lookup",
    f"""SELECT p_partkey, common AS species_common,
          CASE common WHEN 'Dauphin commun' THEN 'Delphinus delphis' WHEN 'Marsouin commun' THEN 'Phocoena phocoena'
            WHEN 'Phoque gris' THEN 'Halichoerus grypus' WHEN 'Cachalot' THEN 'Physeter macrocephalus' END AS species_scientific
        FROM (SELECT p_partkey, trim(regexp_replace(replace([{_label_array()}][cast(p_partkey % 6 AS int) + 1],
                chr(160), ' '), ' +', ' ', 'g')) AS common FROM part)""",
)
def scientific_names(spark, folder):
    label = F.element_at(F.array(*(F.lit(x) for x in LABELS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return species.with_scientific_name(
        inputs.table(spark, folder, "part").select("p_partkey", label.alias("label")), F.col("label")
    ).select("p_partkey", "species_common", "species_scientific")


@query(
    "j1_species_common",
    """SELECT p_partkey, nullif(name, '') AS species_scientific,
         CASE name WHEN 'Orcinus orca' THEN 'Orque' WHEN 'Kogia sima' THEN 'Cachalot nain' END AS species_common
       FROM (SELECT p_partkey, ['Orcinus orca', '', 'Kogia sima', 'Homo sapiens'][cast(p_partkey % 4 AS int) + 1] AS name
             FROM part)""",
)
def common_names(spark, folder):
    names = F.array(*(F.lit(x) for x in ("Orcinus orca", "", "Kogia sima", "Homo sapiens")))
    name = F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int"))
    return species.with_common_name(
        inputs.table(spark, folder, "part").select("p_partkey", name.alias("name")), F.col("name")
    ).select("p_partkey", "species_scientific", "species_common")
