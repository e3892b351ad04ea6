"""Counts, histograms and column descriptions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.operators.quantiles import quantiles_from_counts

QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-null value, most frequent first and by value on ties."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), key)
    )


def dense_counts(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows for every value from ``low`` to ``high``; absent values count 0."""
    domain = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(column))
    counts = (
        df.filter(F.col(column).between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    return domain.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dense_share(
    df: DataFrame, group: str, groups: Sequence[int], column: str, low: int, high: int
) -> DataFrame:
    """Share of each value within its group, over the full group × value domain.

    One aggregate over the table; everything after it has one row per domain cell.
    """
    domain = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(g) for g in groups])).alias(group)
    )
    domain = domain.withColumn(column, F.explode(F.sequence(F.lit(low), F.lit(high))))
    counts = (
        df.filter(F.col(group).isin(*groups)).groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(W.partitionBy(group))
    return (
        domain.join(counts, [group, column], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("share", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))
    )


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Count per equal-width bin from minimum to maximum, last bin closed, empty bins 0."""
    bounds = df.agg(
        F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    ).scalar()
    placed = df.withColumn("_bounds", bounds)
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    position = F.try_divide(F.col(column) - low, high - low) * bins
    bin_number = F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return dense_counts(placed.select(bin_number.alias("bin")), "bin", 0, bins - 1)


def _as_rows(columns: Sequence[str], *fields: tuple[str, Callable[[str], Column]]) -> Column:
    """One struct per column: its name and the given fields."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[build(c).alias(name) for name, build in fields])
            for c in columns
        ]
    )


def describe_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of numeric columns per group.

    Moments take one aggregate over the table. For the quartiles the rows are
    counted per distinct value first, so repeated values collapse before any shuffle.
    """
    keys = [group, "column"]
    moments = (
        df.groupBy(group)
        .agg(
            _as_rows(
                columns,
                ("count", F.count),
                ("mean", F.avg),
                ("std", F.stddev_samp),
                ("min", lambda c: F.min(c).cast("double")),
                ("max", lambda c: F.max(c).cast("double")),
            ).alias("_described")
        )
        .select(group, F.inline("_described"))
    )
    counts = (
        df.select(group, F.inline(_as_rows(columns, ("value", lambda c: F.col(c).cast("double")))))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    quartiles = (
        quantiles_from_counts(counts, keys, "value", "_rows", QUARTILES)
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{int(p * 100)}")
                for p in QUARTILES
            ]
        )
    )
    found = quartiles.withColumnsRenamed({k: f"{k}_found" for k in keys})
    same = F.col(group).eqNullSafe(F.col(f"{group}_found")) & (F.col("column") == F.col("column_found"))
    return moments.join(found, same, "left").drop(*[f"{k}_found" for k in keys])


def column_profile(df: DataFrame) -> DataFrame:
    """Column name, Spark type, rows and non-null rows, from one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(dtype).alias("column_type"),
                    F.count(F.col(name)).alias("non_null"),
                )
                for name, dtype in df.dtypes
            ]
        ).alias("_columns"),
    )
    return counts.select("_rows", F.inline("_columns")).withColumnRenamed("_rows", "rows")


def non_null_shares(df: DataFrame, group: str) -> DataFrame:
    """Per group and other column: rows, non-null values, and their share of the table's non-null values.

    One pass over the table; the totals are summed from the few rows of the aggregate.
    """
    columns = [c for c in df.columns if c != group]
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), _as_rows(columns, ("non_null", F.count)).alias("_columns")
    )
    total = F.sum("non_null").over(W.partitionBy("column"))
    return counts.select(group, "rows", F.inline("_columns")).withColumn(
        "share", F.try_divide(F.col("non_null"), total)
    )


def columns_of_type(df: DataFrame, *types: str) -> list[str]:
    """Names of the columns with one of the given Spark types."""
    return [name for name, dtype in df.dtypes if dtype in types]
