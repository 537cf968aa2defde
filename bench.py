"""Time the headline queries: median of warm runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from headway.registry import QUERIES
from headway.session import local_session

HEADLINE = (
    "route_daily_kpis", "silver_positions", "bronze_profile", "bronze_totals", "delay_alerts",
    "bunching_alerts", "bunching_alerts_900s", "route_vehicle_sessions", "latest_vehicle_state",
    "nearest_stop", "route_deviation", "congestion_grid", "enriched_positions",
    "engineered_features", "gtfs_tables", "src_positions_json", "stream_delay_alerts",
    "stream_bunching_alerts",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"),
                          os.environ.get("BENCH_MEMORY", "7g"), "headway-bench")
    seconds = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "sum of median warm query times", "unit": "sec",
                      "value": round(sum(seconds.values()), 3), "queries": seconds,
                      "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
