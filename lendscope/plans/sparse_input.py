"""One sparse model input from numeric columns, indicators and word counts.

Every value is a coordinate (row, position, value). Positions come from distributed numberings, so neither the
categories nor the vocabulary pass through the driver; it knows their counts alone. A row's coordinates become a
Spark ML sparse vector in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lendscope.operators.encoding import indicator_rows
from lendscope.operators.numbering import dense_numbers
from lendscope.plans.tags import bag_of_words
from lendscope.session import cut_lineage

MISSING = -1.0
_PARSED = StructType([StructField("vector", VectorUDT())])


@dataclass(frozen=True)
class SparseInput:
    """``coordinates`` (row id, position, value) of a matrix with ``size`` columns, which ``columns`` names."""

    coordinates: DataFrame
    columns: DataFrame
    size: int


def _numbered(found: DataFrame, keys: Sequence[str], start: int) -> tuple[DataFrame, int]:
    """Distinct ``keys`` of ``found`` with their ``position`` from ``start`` on, in their own order."""
    numbered = cut_lineage(dense_numbers(found.select(*keys).distinct(), [F.col(k) for k in keys], "position"))
    return numbered.withColumn("position", F.col("position") + start), numbered.count()


def sparse_input(stats: DataFrame, dense: Sequence[str], places: DataFrame, categories: Sequence[str], tags: DataFrame) -> SparseInput:
    """Rows of ``stats`` by ``user_id``: numeric columns, then indicators of ``places``, then the words of ``tags``.

    Columns keep that order; indicators go by category and value, words alphabetically. Missing numbers
    become ``MISSING``; users without place or tags have no coordinates there.
    """
    numbers = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("position"), F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias("value"))
            for i, c in enumerate(dense)
        ]
    )
    users = stats.select("user_id")
    held = indicator_rows(places, "user_id", categories)
    values, n_values = _numbered(held, ["category", "value"], len(dense))
    words = cut_lineage(bag_of_words(tags).select("user_id", "word", "n"))
    vocabulary, n_words = _numbered(words, ["word"], len(dense) + n_values)
    parts = [
        held.join(values, ["category", "value"]).select("user_id", "position", F.col("indicator").cast("double").alias("value")),
        words.join(vocabulary, "word").select("user_id", "position", F.col("n").cast("double").alias("value")),
    ]
    coordinates = stats.select("user_id", F.inline(numbers))
    for part in parts:
        coordinates = coordinates.unionByName(part.join(users, "user_id", "left_semi"))
    named = stats.sparkSession.createDataFrame([("number", c, i) for i, c in enumerate(dense)], "kind string, name string, position long")
    columns = (
        named.unionByName(values.select(F.col("category").alias("kind"), F.col("value").alias("name"), "position"))
        .unionByName(vocabulary.select(F.lit("word").alias("kind"), F.col("word").alias("name"), "position"))
    )
    return SparseInput(coordinates, columns, len(dense) + n_values + n_words)


def _vector(size: int, entries: Column) -> Column:
    """A sparse vector from sorted (position, value) pairs; Spark parses vectors from their own fields."""
    fields = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["position"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["value"]).alias("values"),
    )
    return F.from_json(F.to_json(F.struct(fields.alias("vector"))), _PARSED)["vector"]


def vectors(matrix: SparseInput, row_id: str = "user_id", name: str = "features") -> DataFrame:
    """One sparse vector per row. A task holds the non-zero entries of one row at a time."""
    entries = F.array_sort(F.collect_list(F.struct("position", "value")))
    gathered = matrix.coordinates.groupBy(row_id).agg(entries.alias("_entries"))
    return gathered.select(row_id, _vector(matrix.size, F.col("_entries")).alias(name))


def entries(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """The coordinates of sparse vectors: what a model reads."""
    fields = F.unwrap_udt(F.col(vector))
    zipped = F.arrays_zip(fields["indices"].alias("position"), fields["values"].alias("value"))
    return rows.select(row_id, F.inline(zipped)).withColumn("position", F.col("position").cast("long"))


def audit(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Rows, distinct ids, least and greatest size, entries, and entries out of order or range."""
    fields = rows.select(row_id, F.unwrap_udt(F.col(vector)).alias("v"))
    place = F.col("v.indices")
    rising = F.forall(F.sequence(F.lit(1), F.size(place)), lambda i: (i == 1) | (F.get(place, i - 1) > F.get(place, i - 2)))
    inside = F.forall(place, lambda i: (i >= 0) & (i < F.col("v.size")))
    return fields.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(row_id).alias("ids"),
        F.min("v.size").alias("least_size"),
        F.max("v.size").alias("greatest_size"),
        F.sum(F.size(place)).alias("entries"),
        F.count(F.when(~(rising & inside) | (F.size(place) != F.size("v.values")), 1)).alias("faults"),
    )


def joined_input(rows: DataFrame, dense: str, users: DataFrame, matrix: SparseInput, name: str = "all_features") -> DataFrame:
    """``rows`` (with ``user_id`` and a vector ``dense``) with their user's sparse vector appended; users without one get an empty one."""
    empty = _vector(matrix.size, F.array().cast("array<struct<position:bigint,value:double>>"))
    both = rows.join(users.withColumnRenamed("features", "_user"), "user_id", "left").withColumn("_user", F.coalesce("_user", empty))
    return VectorAssembler(inputCols=[dense, "_user"], outputCol=name).transform(both).drop("_user")
