"""Skew trial: the feature table where one user holds a third of all listings and log rows.

``python tests/skew_trial.py [LISTINGS]`` (default 3,000,000; four log rows each) prints the seconds, the rows, and for
the stages with the longest tasks the longest and the median task. Tables are made by Spark; tasks are read from
Spark's event log in a new temporary folder.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lendscope.plans.feature_table import LendingTables, feature_table  # noqa: E402
from lendscope.session import build_session  # noqa: E402

HOT_USER = 7
ROWS_PER_LISTING = 4
STAGES = 8


def skewed_tables(spark: SparkSession, listings: int) -> LendingTables:
    """Ordinary users have about 30 listings each; every third listing belongs to the hot user."""
    i = F.col("id")
    base = spark.range(listings).select(
        F.when(i % 3 == 0, HOT_USER).otherwise(1000 + i % (listings // 45 + 1)).cast("long").alias("user_id"),
        i.alias("listing_id"),
        F.date_add(F.lit("2018-01-01").cast("date"), (i % 360).cast("int")).alias("auditing_date"),
    )
    day = F.col("auditing_date")
    loans = base.withColumn("due_date", F.date_add(day, 30)).withColumn("due_amt", 100.0 + F.col("listing_id") % 97)
    late = F.col("listing_id") % 11 == 0
    paid = F.date_sub("due_date", (F.col("listing_id") % 20).cast("int")).cast("string")
    train = loans.filter(F.col("listing_id") % 5 > 0).withColumns(
        {
            "repay_date": F.when(late, "\\N").otherwise(paid),
            "repay_amt": F.when(late, "\\N").otherwise(F.col("due_amt").cast("string")),
        }
    )
    info = base.withColumns(
        {
            "term": (3 * (F.col("listing_id") % 4 + 1)).cast("int"),
            "rate": (70 + F.col("listing_id") % 6) / 10,
            "principal": (500 + F.col("listing_id") % 6000).cast("int"),
        }
    )
    log = loans.withColumn("order_id", F.explode(F.sequence(F.lit(1), F.lit(ROWS_PER_LISTING)))).select(
        "user_id", "listing_id", "order_id", "due_date", "due_amt",
        F.date_sub("due_date", ((F.col("listing_id") + F.col("order_id")) % 25).cast("int")).alias("repay_date"),
        F.col("due_amt").alias("repay_amt"),
    )
    users = base.select("user_id").distinct()
    inserted = F.lit("2018-05-01").cast("date")
    profiles = users.select(
        "user_id", inserted.alias("reg_mon"), F.lit("男").alias("gender"), F.lit("p1").alias("cell_province"),
        F.lit("p1").alias("id_province"), F.concat(F.lit("c"), F.col("user_id") % 40).alias("id_city"), inserted.alias("insertdate"),
    )
    tags = users.select("user_id", F.lit("a|b").alias("taglist"), inserted.alias("insertdate"))
    test = loans.filter(F.col("listing_id") % 5 == 0)
    return LendingTables(train, test, info, profiles, tags, log)


def stage_tasks(folder: str) -> dict[int, list[float]]:
    """Seconds of every task by stage."""
    tasks: dict[int, list[float]] = {}
    for path in Path(folder).iterdir():
        for line in path.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                tasks.setdefault(event["Stage ID"], []).append(event["Task Metrics"]["Executor Run Time"] / 1000)
    return tasks


def main(listings: int) -> None:
    events = tempfile.mkdtemp(prefix="lendscope-events-")
    spark = build_session(
        "lendscope-skew",
        "local[8]",
        spark__sql__shuffle__partitions="32",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
        spark__eventLog__enabled="true",
        spark__eventLog__dir=f"file://{events}",
        spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    table: DataFrame = feature_table(skewed_tables(spark, listings))
    rows = table.agg(F.count(F.lit(1)), *[F.count(c) for c in table.columns]).first()[0]
    took = time.perf_counter() - started
    spark.stop()
    print(f"{listings} listings, {ROWS_PER_LISTING * listings} log rows: {rows} rows in {took:.0f} s")
    stages = sorted(((max(t), statistics.median(t), len(t), k) for k, t in stage_tasks(events).items()), reverse=True)
    for longest, middle, count, stage in stages[:STAGES]:
        print(f"stage {stage}: {count} tasks, longest {longest:.1f} s, median {middle:.1f} s")


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000)
