"""Reading and writing the lending tables as files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.sources.schemas import SCHEMAS

MISSING_TEXT = "\\N"
BROKEN = "_broken"
# Microseconds are kept; the writer's own default cuts them to milliseconds.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    """One lending table with its declared schema.

    CSV columns are found by the names in the header, in any order; further columns are ignored and
    an absent one is an error.

    In CSV files the text ``\\N`` is kept where the column is a string, since
    labels and profiles compare against it; in typed columns it reads as null.
    """
    schema = SCHEMAS[name]
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    # No schema: it would name the columns by position and skip the header unread.
    text = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    absent = [field.name for field in schema if field.name not in text.columns]
    if absent:
        raise ValueError(f"{name}.csv lacks the columns {', '.join(absent)}")
    return text.select([_typed(field.name, field.dataType.simpleString()) for field in schema])


def _typed(name: str, dtype: str) -> Column:
    if dtype == "string":
        return F.col(name)
    text = F.col(name)
    return F.when(text != MISSING_TEXT, text).cast(dtype).alias(name)


@dataclass(frozen=True)
class CheckedTable:
    """Rows that fit the table's schema, and the others as text with a reason."""

    rows: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """Rejected rows by reason."""
        return self.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_checked(spark: SparkSession, folder: str, name: str) -> CheckedTable:
    """A CSV table as ``read_table`` reads it, with broken rows set apart instead of failing or turning null.

    Reason ``fields``: the line has too few or too many; otherwise the columns whose text is no value of
    their type, joined by commas. The text ``\\N`` and empty fields are missing values, not broken ones.
    """
    schema = SCHEMAS[name]
    path = f"{folder}/{name}.csv"
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    absent = [field.name for field in schema if field.name not in header]
    if absent:
        raise ValueError(f"{name}.csv lacks the columns {', '.join(absent)}")
    layout = ", ".join(f"`{c}` string" for c in [*header, BROKEN])
    text = (
        spark.read.schema(layout)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", BROKEN)
        # All fields are parsed, so that a broken line counts whatever columns are read.
        .option("columnPruning", False)
        .csv(path)
    )
    typed = [field for field in schema if field.dataType.simpleString() != "string"]
    unread = F.array(
        *[
            F.when(
                (F.col(f.name) != MISSING_TEXT) & F.col(f.name).try_cast(f.dataType.simpleString()).isNull(), f.name
            )
            for f in typed
        ]
    )
    named = F.array_join(F.array_compact(unread), ",") if typed else F.lit("")
    reason = F.when(F.col(BROKEN).isNotNull(), "fields").otherwise(F.nullif(named, F.lit("")))
    tagged = text.withColumn("reason", reason)
    line = F.coalesce(BROKEN, F.to_csv(F.struct(*[F.col(c) for c in header])))
    good = tagged.filter(F.col("reason").isNull())
    return CheckedTable(
        good.select([_typed(f.name, f.dataType.simpleString()) for f in schema]),
        tagged.filter(F.col("reason").isNotNull()).select("reason", line.alias("line")),
    )


def decode_missing(column: str, dtype: str, default: Column) -> Column:
    """Text column to ``dtype``; the text ``\\N`` becomes ``default``, null stays null."""
    text = F.col(column)
    return F.when(text == MISSING_TEXT, default).otherwise(text.try_cast(dtype))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Chosen columns as CSV with a header; each task writes its own file."""
    (
        df.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", TIME_FORMAT)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_sorted_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """As ``write_csv``, in ``order`` within each file and from file to file by name, without a sort in one task."""
    write_csv(df.repartitionByRange(*order).sortWithinPartitions(*order), path, columns)


def round_trip(df: DataFrame, name: str, folder: str) -> DataFrame:
    """``name`` written as CSV and read back: rows written, read and rejected, and rows that differ.

    Both sides are counted per row value, so order does not matter and repeated rows do.
    """
    columns = SCHEMAS[name].names
    write_csv(df, f"{folder}/{name}.csv", columns)
    checked = read_checked(df.sparkSession, folder, name)
    sides = df.select(*columns, F.lit(1).alias("_side")).unionByName(checked.rows.withColumn("_side", F.lit(-1)))
    values = sides.groupBy(*columns).agg(
        F.count_if(F.col("_side") == 1).alias("written"), F.count_if(F.col("_side") == -1).alias("read")
    )
    sums = values.agg(
        F.sum("written").alias("written"), F.sum("read").alias("read"), F.sum(F.abs(F.col("written") - F.col("read"))).alias("different")
    )
    lost = checked.rejected.agg(F.count(F.lit(1))).scalar()
    return sums.select(F.lit(name).alias("name"), "written", "read", lost.alias("rejected"), "different")
