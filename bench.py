"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query writes to the no-op sink, so every column of every row is computed. It runs
twice and the second, warm run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "s9_merge_upsert",
    "a14_merge_by_precedence",
    "a4_daily_sea_state",
    "a1_collapse_cells",
    "a2_release_seeds",
    "a7_monthly_matrix",
    "j2_snap_to_segment",
    "j3_nearest_events",
    "j4_kernel_interpolate",
    "j9_sample_field",
    "w1_circular_window_sum",
    "w5_fill_gaps",
    "w7_segment_lines",
    "a6_persistence",
    "m6_risk_days",
    "a13_skill",
    "m5_fit",
    "c4_coverage_gaps",
)


def run(query, spark, folder: str) -> float:
    from tidewrack.session import release_settled

    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - started
    release_settled(spark)
    return seconds


def readers(spark, folder: str) -> dict:
    """Readers over payload files landed beforehand (making the files is not timed)."""
    from tidewrack.catalog.landed import effort_payloads, weather_payloads
    from tidewrack.sources.fishing import read_fishing_effort
    from tidewrack.sources.weather import PRODUCTS, read_hourly_weather

    landed = tempfile.mkdtemp(prefix="landed-", dir="/tmp")
    weather_payloads(spark, folder).repartition(16).write.text(f"{landed}/weather")
    effort_payloads(spark, folder).select("value").repartition(16).write.text(f"{landed}/effort")
    product = PRODUCTS["weather_archive"]
    return {
        "s1_read_hourly_weather": lambda s, _: read_hourly_weather(s, f"{landed}/weather", product),
        "s2_read_fishing_effort": lambda s, _: read_fishing_effort(s, f"{landed}/effort"),
    }


def main() -> None:
    from tidewrack.catalog import QUERIES
    from tidewrack.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    timed = {name: QUERIES[name] for name in HEADLINE} | readers(spark, folder)
    wanted = sys.argv[1:] or list(timed)
    seconds = {}
    for name in wanted:
        query = timed.get(name) or QUERIES[name]
        run(query, spark, folder)
        seconds[name] = round(run(query, spark, folder), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
