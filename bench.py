"""Seconds per headline query, median of three runs after one warm-up, as one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads.
Results go to Spark's ``noop`` sink, so every row is computed and none is collected.
Timed are the plans themselves, without the rounding that only comparisons need.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lendscope.catalog import QUERIES
from lendscope.session import build_session

HEADLINE = [
    "label_distribution",
    "listing_features",
    "user_profile_features",
    "user_repay_stats",
    "user_month_stats",
    "user_rate_stats",
    "all_order_distribution",
    "tier_feature_on_fact",
    "tier_amount_stats",
    "behaviour_weekday_share",
    "behaviour_year_describe",
    "user_mean_hour_histogram",
    "tag_frequency",
    "tag_tfidf",
    "stratified_folds",
    "prediction_metrics",
    "daily_forecast",
    "feature_table",
]
RUNS = 3


def seconds(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "lendscope-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, folder)
        timings[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(RUNS)), 3)
    spark.stop()
    report = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
