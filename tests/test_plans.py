"""Invariants of the composed plans and the shape of their physical plans."""

import random
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lendscope.catalog import QUERIES, _fact, _tables
from lendscope.oracle import ORACLE
from lendscope.plans import behaviour, facts, feature_table, history, metrics, model, tiers
from lendscope.plans.model import CrossValidation, ForestSettings
from lendscope.sources.lending_views import READS, STAR_SCHEMAS, LendingViews


@pytest.fixture(scope="module")
def features(views):
    return feature_table.feature_table(_tables(views)).cache()


@pytest.fixture(scope="module")
def validation(views):
    return CrossValidation.run(_tables(views), ForestSettings(trees=3, depth=3))


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 1500
    assert driver.queries().keys() >= QUERIES.keys()
    assert driver.oracle_sql().items() >= ORACLE.items()


def test_no_join_fans_out(views, features):
    rows = views.train().count() + views.test().count()
    assert features.count() == rows
    assert features.select("listing_id").distinct().count() == rows


def test_features_are_numeric_and_free_of_targets(features):
    assert {t for _, t in features.dtypes} <= {"int", "bigint", "double", "boolean"}
    inputs = feature_table.feature_columns(features)
    assert not {"label", "repay_amt", "repay_weekday", "user_id", "listing_id"} & set(inputs)
    assert len(inputs) == len(set(inputs))


def test_fused_history_equals_separate_grains(views):
    log = history.first_order_log(views.user_repay_logs())
    fused = history.user_history(log)
    separate = history.user_stats(log)
    names = [c for c in separate.columns if c != "user_id"]
    joined = fused.alias("f").join(separate.alias("s"), "user_id", "full")
    worst = joined.agg(
        *[F.max(F.abs(F.coalesce(F.col(f"f.{c}") - F.col(f"s.{c}"), F.lit(9.0)))).alias(c) for c in names]
    ).first()
    assert max(worst) < 1e-9
    months = fused.select("user_id", F.explode("dm").alias("due_month", "stats")).select(
        "user_id", "due_month", "stats.*"
    )
    assert months.count() == history.user_month_stats(log).count()


def test_unpaid_rows_count_as_wednesday(spark):
    rows = [(1, 1, 1, "2018-05-05", 10.0, "2200-01-01"), (1, 2, 1, "2018-05-05", 10.0, "2018-05-09")]
    log = spark.createDataFrame(
        rows, "user_id long, listing_id long, order_id int, due_date string, due_amt double, repay_date string"
    ).withColumns({c: F.col(c).cast("date") for c in ("due_date", "repay_date")})
    out = history.first_order_log(log).orderBy("listing_id").collect()
    assert [(r["repay"], r["early_repay_days"], r["repay_weekday"]) for r in out] == [(0, -1, 3), (1, -1, 3)]


def test_tier_bounds_are_inclusive_below(spark):
    activity = spark.createDataFrame(
        [(u, f, f, f) for u, f in enumerate([1, 2, 3, 4, 10])],
        "user_id long, freq long, early_days_sum long, early_days_squares long",
    )
    tiered = tiers.with_tier(activity, tiers.TierBounds.quartiles(activity))
    assert {r["freq"]: r["tier"] for r in tiered.collect()} == {
        1: "lower", 2: "median", 3: "median", 4: "most", 10: "most",
    }


def test_split_keeps_every_row(views):
    train, test = facts.split_fact(_fact(views))
    assert (train.count(), test.count()) == (views.train().count(), views.test().count())


def test_shares_sum_to_one(views):
    for shares in (behaviour.weekday_share, behaviour.month_share):
        total = shares(views.user_behavior_logs()).groupBy("behavior_type").agg(F.sum("share").alias("s"))
        assert [r["s"] for r in total.collect()] == [pytest.approx(1.0)] * 3


def test_folds_are_balanced(spark, small_dir):
    balance = QUERIES["fold_label_balance"](spark, small_dir)
    spread = balance.groupBy("label").agg((F.max("n") - F.min("n")).alias("d"), F.count("*").alias("folds"))
    assert spread.filter("d > 1").count() == 0


def test_out_of_fold_scores_each_row_once(views, validation):
    scored = validation.out_of_fold()
    assert scored.count() == views.train().count()
    assert scored.select("listing_id").distinct().count() == views.train().count()
    sizes = scored.select(F.size("probabilities").alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [33]
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    assert scored.filter(F.abs(total - 1) > 1e-9).count() == 0


def test_test_probabilities_are_the_fold_mean(views, validation):
    scored = validation.test_probabilities()
    assert scored.count() == views.test().count()
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    assert scored.filter((F.size("probabilities") != 33) | (F.abs(total - 1) > 1e-9)).count() == 0


def test_metrics_on_hand_made_scores(spark):
    rows = [(0, 0, 10.0, 10.0, [0.5, 0.5]), (1, 1, 10.0, 0.0, [0.75, 0.25])]
    scored = spark.createDataFrame(
        rows, "fold int, label int, due_amt double, repay_amt double, probabilities array<double>"
    )
    found = {r["fold"]: r for r in metrics.prediction_metrics(scored).collect()}
    assert found[0]["rmse"] == pytest.approx(5.0)
    assert found[1]["mae"] == pytest.approx(2.5)
    assert found[-1]["rmse"] == pytest.approx(((25 + 6.25) / 2) ** 0.5)
    assert (found[0]["accuracy"], found[1]["accuracy"], found[-1]["n"]) == (1.0, 0.0, 2)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_pair_joins_or_python_in_plans(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    plan = QUERIES["user_repay_stats"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,1)" in plan
    assert "l_extendedprice" not in plan


def test_a_stored_fit_is_read_back(views, monkeypatch):
    fits = []
    fit = model._fit
    monkeypatch.setattr(model, "_fit", lambda rows, settings: fits.append(settings) or fit(rows, settings))
    # Settings of this run alone: the shared folder may hold the fits of earlier ones.
    tables, small = _tables(views), ForestSettings(trees=2, depth=2, subsample=0.9 + random.random() / 20)
    first = CrossValidation.stored(tables, small).out_of_fold()
    assert len(fits) == model.FOLDS
    again = CrossValidation.stored(_tables(views), small).out_of_fold()
    assert len(fits) == model.FOLDS
    assert first.exceptAll(again).count() == 0
    assert model.fit_key(tables, small) != model.fit_key(tables, ForestSettings(trees=3, depth=2))
    fewer = replace(tables, train=tables.train.filter("listing_id <> 7"))
    assert model.fit_key(fewer, small) != model.fit_key(tables, small)


def test_a_fit_cut_short_goes_on(views, monkeypatch):
    calls, done, built = [], [], []
    fit, assembled = model._fit, model.assembled

    def failing(rows, settings):
        calls.append(settings)
        if len(calls) == 3:
            raise RuntimeError("cut short")
        done.append(fit(rows, settings))
        return done[-1]

    monkeypatch.setattr(model, "_fit", failing)
    monkeypatch.setattr(model, "assembled", lambda features: built.append(1) or assembled(features))
    small = ForestSettings(trees=2, depth=2, subsample=0.8 + random.random() / 20)
    with pytest.raises(RuntimeError, match="cut short"):
        CrossValidation.stored(_tables(views), small)
    assert 2 <= len(done) < model.FOLDS
    again = CrossValidation.stored(_tables(views), small)
    assert (len(done), len(built)) == (model.FOLDS, 1)
    assert again.out_of_fold().count() == views.train().count()


def test_folds_run_at_the_same_time_under_the_callers_properties(spark):
    spark.sparkContext.setLocalProperty("lendscope.test", "caller")
    meet = threading.Barrier(model.PARALLEL_FITS, timeout=60)
    together = model.FOLDS - model.FOLDS % model.PARALLEL_FITS

    def step(fold):
        if fold < together:
            meet.wait()
        return fold, spark.sparkContext.getLocalProperty("lendscope.test")

    assert model._per_fold(spark, step) == [(fold, "caller") for fold in range(model.FOLDS)]
    spark.sparkContext.setLocalProperty("lendscope.test", None)


def test_the_fit_key_joins_nothing(views):
    """Views count by the stored tables that they read, and READS names all of those."""
    tables = _tables(views)
    assert tables.named().keys() == READS.keys()
    for frame in tables.named().values():
        stored = tables.made_of(frame)
        assert sorted(frame.inputFiles()) == sorted(f for df in stored for f in df.inputFiles())
        for df in stored:
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_the_fit_key_follows_the_rows(spark, views, small_dir, tmp_path):
    def key(folder, **changed):
        for name in STAR_SCHEMAS.keys() - {"events"}:
            rows = spark.read.parquet(f"{small_dir}/{name}.parquet").repartition(3)
            changed.get(name, lambda df: df)(rows).write.parquet(f"{folder}/{name}.parquet")
        return model.fit_key(_tables(LendingViews(spark, str(folder))), ForestSettings())

    own = model.fit_key(_tables(views), ForestSettings())
    assert key(tmp_path / "moved") == own
    dearer = F.when(F.col("l_orderkey") == 7, F.col("l_extendedprice") + 0.01).otherwise(F.col("l_extendedprice"))
    keys = {
        own,
        key(tmp_path / "dearer", lineitem=lambda df: df.withColumn("l_extendedprice", dearer)),
        key(tmp_path / "fewer", customer=lambda df: df.filter("c_custkey <> 1")),
        key(tmp_path / "twice", part=lambda df: df.union(df.filter("p_partkey = 1"))),
    }
    tables = _tables(views)
    for name, df in tables.named().items():
        keys.add(model.fit_key(replace(tables, **{name: df.limit(0)}), ForestSettings()))
    assert len(keys) == 4 + len(READS)


def test_the_assembling_projection_gets_compiled(spark, features):
    """The JVM leaves methods beyond 8,000 bytes to its interpreter."""
    vectors = model.assembled(features.withColumn("fold", F.lit(0)))
    vectors.collect()
    plan = vectors._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    assert max([stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())], default=0) < 8000


def test_audit_finds_faults(spark):
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.6]), (1, 2, [1.0])]
    scored = spark.createDataFrame(rows, "fold int, listing_id long, probabilities array<double>")
    assert sorted(map(tuple, model.audit(scored).collect())) == [(0, 2, 1, 2, 2, 1), (1, 1, 1, 1, 1, 0)]
