"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` selects the tables, ``BENCH_CPUS`` the local cores.  Results go
to the ``noop`` sink, so every row of every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from conformance.queries import registry
from ironlog.session import tuned

HEADLINE = (
    "max_1rm_by_lift",
    "with_1rm",
    "rm_progression",
    "recent_progress",
    "workout_stats",
    "rep_prs",
    "progression_series",
    "weekly_volume",
    "monthly_frequency",
    "clean_removal_counts",
    "rule_violations",
    "suspicious_rows",
    "search_lifter",
    "meets_long",
    "competition_bests",
    "trend_fit",
    "trend_fit_robust",
    "forecast",
    "goal_grid",
    "meet_attempts",
    "rep_band_stats",
    "optimal_frequency",
    "volume_buckets",
    "window_sweep",
    "normalize",
)


def session(cpus: str) -> SparkSession:
    spark = (
        tuned(SparkSession.builder.master(f"local[{cpus}]"))
        .appName("ironlog-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = registry()
    chosen = sys.argv[1:] or HEADLINE
    # start the JVM's code paths outside the measurement
    queries["date_coverage"](spark, sf_dir).collect()

    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
