"""Latest rows, row numbers and folds without single-task sorts, look-ups and membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, date: str) -> DataFrame:
    """Newest row per key; on equal dates the row with the greatest remaining columns.

    Spark prunes each map task to its best row per key before the shuffle, so
    a key with very many rows stays cheap.
    """
    ties = [F.col(c).desc_nulls_last() for c in df.columns if c not in (key, date)]
    newest = W.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), *ties)
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 2019, digits: int = 3
) -> DataFrame:
    """Add ``fold``: rows of each label in the order of a seeded hash, dealt out in turn.

    A row's number within its label is the rows in earlier hash buckets plus
    its number in its own bucket, so no task sorts a whole label.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    buckets = bucketed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(label).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(
        label, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    within = W.partitionBy(label, "_bucket").orderBy("_hash", row_id)
    return (
        bucketed.join(starts, [label, "_bucket"], "left")
        .withColumn(
            "fold", ((F.col("_start") + F.row_number().over(within) - 1) % folds).cast("int")
        )
        .drop("_hash", "_bucket", "_start")
    )


def rows_of(sources: dict[str, DataFrame], key: str, value: Column, columns: Sequence[str]) -> DataFrame:
    """The rows of several tables whose ``key`` is ``value``, with the table's name; the filter reaches each scan."""
    found = [
        df.filter(F.col(key) == value).select(F.lit(name).alias("source"), key, *columns)
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, found)


def with_membership(df: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """Add ``flag``: 1 where ``others`` holds the row's key, else 0."""
    held = others.select(key).distinct().withColumn(flag, F.lit(1))
    return df.join(held, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))
