"""Operators against brute force, with skew thresholds low enough to take the hot path."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import encoding, numbering, profiling, quantiles, ranking, skew, stats


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One user with a third of all rows, many with a few; amounts in cents."""
    draw = random.Random(7)
    rows = [(1, draw.randrange(1, 5_000_000) / 100) for _ in range(1000)]
    rows += [(draw.randrange(2, 300), draw.randrange(1, 9000) / 100) for _ in range(2000)]
    rows += [(1, 77.77)] * 300
    data = [(i, user, amount) for i, (user, amount) in enumerate(rows)]
    return data, spark.createDataFrame(data, "id long, user_id long, amount double")


def test_hot_keys_need_rows(skewed):
    _, df = skewed
    assert rows_of(skew.hot_keys(df, "user_id", min_rows=100), "user_id") == [(1,)]
    assert skew.hot_keys(df, "user_id", min_rows=10_000).count() == 0
    assert skew.hot_keys(df, "user_id").count() == 0


def test_left_join_spread_matches_plain_join(spark, skewed):
    data, df = skewed
    dim = spark.createDataFrame([(u, u * 10) for u in range(1, 200)], "user_id long, v long")
    hot = skew.hot_keys(df, "user_id", min_rows=100)
    fact = df.unionByName(spark.createDataFrame([(-1, None, 1.0)], df.schema))
    out = skew.left_join_spread(fact, dim, "user_id", "id", hot=hot)
    expected = sorted((i, u * 10 if u < 200 else None) for i, u, _ in data) + [(-1, None)]
    assert rows_of(out, "id") == sorted((i,) for i, _ in expected)
    assert {r["id"]: r["v"] for r in out.collect()} == dict(expected)


def test_grouped_medians_hot_and_ordinary(skewed):
    data, df = skewed
    hot = skew.hot_keys(df, "user_id", min_rows=100)
    wanted = {"amount_median": "amount", "id_median": "id"}
    for hot_set in (hot, None):
        out = quantiles.grouped_medians(df, "user_id", wanted, hot=hot_set)
        found = {r["user_id"]: (r["amount_median"], r["id_median"]) for r in out.collect()}
        for user in {u for _, u, _ in data}:
            amounts = [a for _, u, a in data if u == user]
            ids = [i for i, u, _ in data if u == user]
            assert found[user] == pytest.approx((statistics.median(amounts), statistics.median(ids)))


@pytest.mark.parametrize(("few", "bins"), [(4096, 1024), (3, 4), (1, 2)])
def test_quantiles_from_counts_equal_numpy(skewed, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW_VALUES", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    data, df = skewed
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    counts = df.groupBy("user_id", "amount").agg(F.count(F.lit(1)).alias("rows"))
    out = quantiles.quantiles_from_counts(counts, ["user_id"], "amount", "rows", probs)
    found = {(r["user_id"], r["prob"]): r["quantile"] for r in out.collect()}
    for user in {u for _, u, _ in data}:
        amounts = [a for _, u, a in data if u == user]
        for p in probs:
            assert found[user, p] == pytest.approx(np.percentile(amounts, 100 * p))


def test_quartiles_of_sparse_64_bit_values(spark):
    """Values over the whole range, by a null and a plain group: more of them than one task may sort."""
    draw = random.Random(11)
    values = [float(draw.choice([1, -1]) * draw.getrandbits(draw.randrange(1, 63))) for _ in range(30_000)] + [1.5e308, -1.5e308]
    rows = [(None if i % 2 else "a", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = profiling.describe_by(df, "g", ["x"])
    for r in out.collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.percentile(mine, [25, 50, 75])))


def test_statistics_of_small_groups(spark):
    groups = {"single": [5.0], "constant": [5.0, 5.0, 5.0], "pair": [1.0, 2.0], "skewed": [1.0, 2.0, 3.0, 10.0]}
    rows = [(g, x) for g, values in groups.items() for x in values]
    out = (
        spark.createDataFrame(rows, "g string, x double")
        .groupBy("g")
        .agg(
            F.avg("x").alias("mean"),
            stats.std_or_zero("x").alias("std"),
            stats.adjusted_skewness("x").alias("skew"),
            stats.excess_kurtosis("x").alias("kurt"),
            stats.value_range("x").alias("ptp"),
        )
    )
    found = {r["g"]: r for r in out.collect()}
    assert (found["single"]["mean"], found["single"]["std"], found["single"]["skew"]) == (5.0, 0.0, None)
    assert found["single"]["kurt"] == -3.0
    assert (found["constant"]["std"], found["constant"]["skew"], found["constant"]["kurt"]) == (0.0, 0.0, -3.0)
    assert found["pair"]["skew"] is None
    assert found["skewed"]["skew"] == pytest.approx(1.763632614803888)
    assert found["skewed"]["kurt"] == pytest.approx(-0.7696)
    assert found["skewed"]["ptp"] == 9.0


def test_mode_takes_lowest_on_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 3, 1, 2)], "x int")
    assert df.agg(stats.mode_lowest("x")).first()[0] == 1


def test_grain_stats_drop_null_keys(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (1, None, 7), (1, 2.0, 9)], "u long, rate double, x int")
    out = stats.grain_stats(df, ["u", "rate"], {"x": ("x", ("mean", "std", "max"))})
    assert rows_of(out, "u", "rate", "x_mean", "x_max") == [(1, 2.0, 7.0, 9)]


def test_latest_per_key_with_ties_and_nulls(spark):
    day = dt.date
    rows = [(1, day(2018, 1, 1), "a"), (1, day(2018, 3, 1), "b"), (1, day(2018, 3, 1), "c"), (2, None, "d")]
    df = spark.createDataFrame(rows, "u long, d date, v string")
    assert rows_of(ranking.latest_per_key(df, "u", "d"), "u", "v") == [(1, "c"), (2, "d")]


def test_latest_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("u"), F.col("id").alias("d"))
    plan = ranking.latest_per_key(df, "u", "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("digits", [1, 3])
def test_stratified_folds_equal_a_single_numbering(spark, digits):
    import hashlib

    labels = [0] * 700 + [1] * 201 + [2] * 3
    rows = list(enumerate(labels))
    df = spark.createDataFrame(rows, "listing_id long, label int")
    out = ranking.stratified_folds(df, "label", "listing_id", digits=digits)
    found = {r["listing_id"]: r["fold"] for r in out.collect()}
    for label in set(labels):
        ids = [i for i, x in rows if x == label]
        ordered = sorted(ids, key=lambda i: hashlib.md5(f"2019:{i}".encode()).hexdigest())
        assert [found[i] for i in ordered] == [n % 5 for n in range(len(ordered))]


@pytest.mark.parametrize(("start", "stop"), [(0, 10), (95, 230), (590, 9999), (700, 800)])
def test_positional_slice_equals_sorted_slice(spark, start, stop):
    draw = random.Random(3)
    rows = [(draw.randrange(40) if i % 3 else 7, draw.randrange(5), i) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    out = numbering.positional_slice(df, ["a", "b", "c"], start, stop)
    expected = [(n, *row) for n, row in enumerate(sorted(rows))][start:stop]
    assert rows_of(out, "position", "a", "b", "c") == expected


def test_dense_tables_hold_absent_values(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 1)], "kind int, x int")
    assert rows_of(profiling.dense_counts(df, "x", 0, 3), "x", "n") == [(0, 2), (1, 1), (2, 1), (3, 0)]
    share = profiling.dense_share(df, "kind", [1, 2, 3], "x", 0, 2)
    found = {(r["kind"], r["x"]): r["share"] for r in share.collect()}
    assert found == {
        (1, 0): pytest.approx(2 / 3), (1, 1): 0.0, (1, 2): pytest.approx(1 / 3),
        (2, 0): 0.0, (2, 1): 1.0, (2, 2): 0.0, (3, 0): 0.0, (3, 1): 0.0, (3, 2): 0.0,
    }


def test_equal_width_histogram_equals_numpy(spark):
    values = [3, 3, 4, 10, 17, 17.5, 20, 35]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = rows_of(profiling.equal_width_histogram(df, "x", 8), "bin", "n")
    assert [n for _, n in found] == list(np.histogram(values, 8)[0])
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert rows_of(profiling.equal_width_histogram(constant, "x", 3), "bin", "n") == [(0, 2), (1, 0), (2, 0)]


def test_describe_equals_pandas(spark, skewed):
    import pandas as pd

    data, df = skewed
    out = profiling.describe_by(df.withColumn("g", F.lit("all")), "g", ["id", "user_id"])
    frame = pd.DataFrame(data, columns=["id", "user_id", "amount"])
    for row in out.collect():
        expected = frame[row["column"]].describe()
        found = [row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert found == pytest.approx(list(expected))


def test_column_profile_and_type_selection(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "x int, s string, d date")
    found = rows_of(profiling.column_profile(df), "column_name", "column_type", "rows", "non_null")
    assert found == [("d", "date", 2, 0), ("s", "string", 2, 1), ("x", "int", 2, 2)]
    assert profiling.columns_of_type(df, "string", "date") == ["s", "d"]


def test_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "z"), (2, "b"), (4, None)], "id long, v string")
    out = encoding.with_codes(df, ["v"], F.col("id"), "id")
    assert {r["id"]: r["v_code"] for r in out.collect()} == {1: 0, 2: 1, 3: 1, 4: None}
    wide = encoding.indicator_columns(df, "v", ["b", "z"])
    assert {r["id"]: (r["v_b"], r["v_z"]) for r in wide.collect()} == {
        1: (0, 1), 2: (1, 0), 3: (1, 0), 4: (0, 0),
    }


def test_value_counts_order(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,), (5,), (None,)], "x int")
    assert [tuple(r) for r in profiling.value_counts(df, "x").collect()] == [(1, 2), (2, 2), (5, 1)]


def test_indicators_have_no_limit_on_values(spark):
    df = spark.createDataFrame([(i, f"v{i}", "x" if i % 2 else None) for i in range(1500)], "id long, v string, w string")
    out = encoding.indicator_rows(df, "id", ["v", "w"])
    assert out.count() == 1500 + 750
    assert [tuple(r) for r in out.where("id = 7").orderBy("category").collect()] == [(7, "v", "v7", 1), (7, "w", "x", 1)]


def test_slices_and_quartiles_keep_null_groups(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int")
    got = numbering.positional_slice(df, ["x"], 0, 3)
    assert sorted((r["position"], r["x"]) for r in got.collect()) == [(0, None), (1, 1), (2, 2)]
    groups = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    found = {r["g"]: r["p50"] for r in profiling.describe_by(groups, "g", ["x"]).collect()}
    assert found == {None: 2.0, "a": 5.0}


def test_non_null_shares_count_each_column(spark):
    df = spark.createDataFrame([(1, 5, None), (1, None, "x"), (2, 7, "y")], "g int, a int, b string")
    found = {(r["g"], r["column"]): (r["rows"], r["non_null"], r["share"]) for r in profiling.non_null_shares(df, "g").collect()}
    assert found == {(1, "a"): (2, 1, 0.5), (1, "b"): (2, 1, 0.5), (2, "a"): (1, 1, 0.5), (2, "b"): (1, 1, 0.5)}


def test_membership_flags_null_keys_as_absent(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    found = ranking.with_membership(left, right, "k", "held").collect()
    assert {r["k"]: r["held"] for r in found} == {1: 0, 2: 1, None: 0}


def test_skewed_left_join_is_split_over_tasks(spark):
    """One key holds most rows: Spark splits its partition, and no row is lost."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        fact = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 10 < 7, 3).otherwise(F.col("id") % 500).alias("k")).repartition(6)
        dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = skew.left_join_unique(fact, dim, "k")
        assert joined.filter("v = 2 * k").count() == 200_000
        done = joined.select("id", "v")
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
