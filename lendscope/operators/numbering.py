"""Numbering the rows of a whole table in order, and slices by that number, without a window over all rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.session import cut_lineage, shared_folder

_MARK = "_lendscope_mark"
#: ``monotonically_increasing_id`` holds the partition above this bit, the row's number in it below.
_PARTITION_BIT = 33


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Range partitions, each sorted, with ``_part`` and the row's number ``_within`` it.

    Without ``partitions`` Spark joins small ones.
    """
    dealt = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    ranged = dealt.sortWithinPartitions(*order).withColumn(_MARK, F.monotonically_increasing_id())
    part = F.shiftright(_MARK, _PARTITION_BIT)
    return ranged.withColumns({"_part": part, "_within": F.col(_MARK) - F.shiftleft(part, _PARTITION_BIT)}).drop(_MARK)


def _offsets(ranged: DataFrame) -> list[tuple[int, int, int]]:
    """First position and rows of every partition: one number per partition reaches the driver."""
    out, total = [], 0
    for part, rows in sorted(ranged.groupBy("_part").count().collect()):
        out.append((part, total, rows))
        total += rows
    return out


def _positioned(ranged: DataFrame, offsets: list[tuple[int, int, int]], name: str) -> DataFrame:
    table = ranged.sparkSession.createDataFrame(offsets, "_part long, _offset long, _rows long")
    placed = ranged.join(F.broadcast(table), "_part")
    return placed.withColumn(name, F.col("_within") + F.col("_offset")).drop("_part", "_within", "_offset", "_rows")


def dense_numbers(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Adds each row's 0-based place in ``order``, which should leave no ties between different rows.

    Range partitions are sorted on their own and written once; the driver turns their sizes, one number
    per partition, into offsets. Rows equal in all of ``order`` share a partition and get different numbers.
    """
    ranged = cut_lineage(_ranged(df, order))
    return _positioned(ranged, _offsets(ranged), name)


@dataclass(frozen=True)
class PositionIndex:
    """A table written in order, one folder per range partition, with each folder's first position."""

    stored: DataFrame
    offsets: list[tuple[int, int, int]]

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> PositionIndex:
        spark = df.sparkSession
        ranged = _ranged(df, order, partitions)
        folder = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
        ranged.write.partitionBy("_part").parquet(folder)
        stored = spark.read.schema(ranged.schema).parquet(folder)
        return cls(stored, _offsets(stored))

    def check_order(self, order: Sequence[str]) -> None:
        """Raise unless every folder's last row comes before the next folder's first: one pair per folder is compared."""
        key = F.struct(*order)
        ends = self.stored.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
        earlier = F.lag("last").over(W.orderBy("_part"))
        wrong = ends.select("_part", (F.col("first") < earlier).alias("wrong")).filter("wrong").collect()
        if wrong:
            raise ValueError(f"folders out of order: {[r['_part'] for r in wrong]}")

    def positioned(self, name: str = "position") -> DataFrame:
        """All rows with their position."""
        return _positioned(self.stored, self.offsets, name)

    def preview(self, rows: int, name: str = "position") -> DataFrame:
        """The first rows; only the folders that hold them are read, mostly one."""
        return self.slice(0, rows, name)

    def touched(self, start: int, stop: int) -> list[int]:
        return [part for part, first, rows in self.offsets if first < stop and first + rows > start]

    def slice(self, start: int, stop: int, name: str = "position") -> DataFrame:
        """Rows [start, stop) with their position; only folders that the slice touches are read."""
        parts = self.stored.filter(F.col("_part").isin(self.touched(start, stop)))
        placed = _positioned(parts, self.offsets, name)
        return placed.filter((F.col(name) >= start) & (F.col(name) < stop))


def positional_slice(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows [start, stop) in the order of ``order``, nulls first, with their position."""
    return PositionIndex.build(df, [F.col(c) for c in order]).slice(start, stop)
