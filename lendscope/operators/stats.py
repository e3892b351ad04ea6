"""Aggregate expressions with the missing-value rules of the lending features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stated value for the excess kurtosis of a constant group.
CONSTANT_KURTOSIS = -3.0


def std_or_zero(column: str) -> Column:
    """Sample standard deviation; 0 for a single row."""
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def mode_lowest(column: str) -> Column:
    """Most frequent value, the smallest on ties. For columns with a bounded domain."""
    return F.mode(column, deterministic=True)


def value_range(column: str) -> Column:
    return F.max(column) - F.min(column)


def adjusted_skewness(column: str) -> Column:
    """Bias-adjusted skewness: null below three rows, 0 for a constant group."""
    n = F.count(column).cast("double")
    adjusted = F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.max(column) == F.min(column), 0.0).otherwise(adjusted)


def excess_kurtosis(column: str) -> Column:
    """Population excess kurtosis; -3 for a constant group."""
    return F.when(F.max(column) == F.min(column), CONSTANT_KURTOSIS).otherwise(F.kurtosis(column))


def mean_from_sums(n: Column, s: Column) -> Column:
    return s / n


def variance_from_sums(n: Column, s: Column, ss: Column) -> Column:
    """Sample variance from count, sum and sum of squares of integers; null for one row."""
    s_double, ss_double = s.cast("double"), ss.cast("double")
    spread = F.greatest(ss_double - s_double * s_double / n, F.lit(0.0))
    return F.when(n > 1, spread / (n - 1))


# Statistic name to expression builder, for tables of grain × measure statistics.
STATISTICS = {
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "std": std_or_zero,
    "mode": mode_lowest,
}


def grain_stats(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, tuple[str, ...]]],
) -> DataFrame:
    """One aggregate per grain: ``measures`` maps an output prefix to (column, statistics).

    Rows with a null key are dropped, as a null key never joins back.
    """
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(
        *[
            STATISTICS[stat](column).alias(f"{prefix}_{stat}")
            for prefix, (column, stats) in measures.items()
            for stat in stats
        ]
    )
