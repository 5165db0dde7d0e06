"""Timings of the headline queries: one warm-up each, then the median of three runs.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from evenkeel.plans.catalog import QUERIES

HEADLINE = [
    "flagship",
    "instant_vector",
    "sum_by_pod_max",
    "quantile_over_time",
    "quantile_over_time_by_user",
    "increase",
    "rate_percent",
    "histogram_quantile",
    "poll_cross_fill",
    "stale_refs",
    "quartiles_bracketed",
    "robust_scale",
    "robust_scale_offset",
    "load_index_p1",
    "load_index_p2",
    "lpt_assignments",
    "lpt_parts",
    "lpt_by_nation",
    "plan_key_hash",
    "plan_diff",
    "evaluation_replay",
    "rollout_state",
    "change_log",
    "gauge_rollup",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    # every row and column is computed, none is sent to the driver
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    timings = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(spark, name, sf_dir)
        timings[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
