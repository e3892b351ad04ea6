"""Numbering by range partitions."""

import re

import pytest
from pyspark.sql import functions as F

from lendscope.operators.encoding import first_appearance_codes
from lendscope.operators.numbering import PositionIndex, dense_numbers


@pytest.mark.parametrize("rows", [0, 1, 7, 5000])
def test_numbers_follow_the_order(spark, rows):
    df = spark.range(rows).select(F.xxhash64("id").alias("a"), F.col("id").alias("b")).repartition(3)
    got = dense_numbers(df, [F.desc("a"), F.asc("b")], "n").collect()
    want = sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(rows))


def test_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (3,), (None,), (1,)], "a int")
    got = sorted((r.n, r.a) for r in dense_numbers(df, [F.asc_nulls_last("a")], "n").collect())
    assert got == [(0, 1), (1, 3), (2, 3), (3, None), (4, None)]


def test_no_window_over_the_table(spark):
    plan = dense_numbers(spark.range(100), [F.col("id")])._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_a_slice_of_sparse_ids_reads_the_partitions_it_touches(spark):
    ids = sorted((i * i * 7919 + (i % 3) * 2**40) for i in range(3000))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    index = PositionIndex.build(df, [F.col("id")], partitions=6)
    assert sum(rows for _, _, rows in index.offsets) == 3000
    for start, stop in [(0, 10), (700, 1500), (2990, 4000), (5000, 6000), (10, 10)]:
        out = index.slice(start, stop)
        assert sorted((r.position, r.id) for r in out.collect()) == list(enumerate(ids))[start:stop]
    assert len(index.touched(0, 10)) == 1 < len(index.offsets)
    scan = index.slice(0, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part", scan)


def test_codes_need_no_window(spark):
    df = spark.range(2000).select(F.col("id"), F.concat(F.lit("v"), F.col("id") * 17 % 700).alias("v"))
    codes = first_appearance_codes(df, "v", F.col("id"))
    assert "Window" not in codes._jdf.queryExecution().toString()
    seen = {}
    for i in range(2000):
        seen.setdefault(f"v{i * 17 % 700}", len(seen))
    assert {r.v: r.v_code for r in codes.collect()} == seen


def test_a_preview_reads_one_folder_and_order_is_checked(spark):
    df = spark.range(4000).select((F.col("id") * 31 % 4001).alias("k"))
    index = PositionIndex.build(df, [F.col("k")], partitions=5)
    index.check_order(["k"])
    assert [r.k for r in index.preview(3).orderBy("position").collect()] == sorted(i * 31 % 4001 for i in range(4000))[:3]
    assert len(index.touched(0, 3)) == 1 and index.positioned().count() == 4000
    backwards = PositionIndex(index.stored.withColumn("k", -F.col("k")), index.offsets)
    with pytest.raises(ValueError, match="out of order"):
        backwards.check_order(["k"])
