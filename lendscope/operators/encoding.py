"""Category codes and indicator columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.operators.numbering import dense_numbers
from lendscope.operators.skew import hot_by_count, left_join_spread


def first_appearance_codes(df: DataFrame, column: str, order: Column) -> DataFrame:
    """Each non-null value, its rank by first appearance under ``order``, and its rows.

    The distinct values are numbered by range partitions, however many there are.
    """
    values = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("rows"))
    )
    numbered = dense_numbers(values, [F.col("_first"), F.col(column)], "_code")
    return numbered.select(column, F.col("_code").cast("int").alias(f"{column}_code"), "rows")


def with_codes(df: DataFrame, columns: Sequence[str], order: Column, row_id: str) -> DataFrame:
    """Add ``<column>_code`` for each column; null values keep a null code."""
    out = df
    for column in columns:
        codes = first_appearance_codes(df, column, order)
        hot = hot_by_count(codes, column, "rows")
        out = left_join_spread(out, codes.drop("rows"), column, row_id, hot=hot)
    return out


def indicator_rows(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Indicators in long form: ``row_id``, ``category`` (column), ``value``, and 1 where a row holds a value.

    A column may have any number of values; all other indicators of a row are 0.
    """
    held = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(row_id, F.inline(held)).filter("value IS NOT NULL").withColumn("indicator", F.lit(1))


def indicator_columns(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Add one 0/1 column ``<column>_<value>`` per listed value."""
    return df.withColumns(
        {
            f"{column}_{value}": F.when(F.col(column) == value, 1).otherwise(0)
            for value in values
        }
    )
