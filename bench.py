"""Times the headline queries at one scale and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fleetwatch.catalog import all_queries
from fleetwatch.session import local_session

HEADLINE = [
    "physics_alerts", "direction_conflict", "scan_repeat", "verify", "drop_replays", "ids", "cooldown", "asof_latest", "node_monitor",
    "graph_diff", "notify", "burst_summary", "patrol_pause", "mission_mode", "rolling_scores", "half_trend", "curriculum",
    "bootstrap_interval", "bootstrap_interval_poisson", "episode_rollup", "path_length", "delta_prev", "visit_progress",
    "safe_positions", "hmac_sha256", "sanitize_ranges", "eval_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fleetwatch-bench")
    catalog = all_queries()
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            catalog[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
