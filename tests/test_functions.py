"""Scalar rules on literal rows, expected values worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendscope.functions import calendar, classes
from lendscope.functions.labels import with_label


def one(spark, column, **values):
    """Value of an expression over a single literal row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("out")).first()["out"]


def date(text):
    return F.lit(text).cast("date")


def test_weekdays(spark):
    assert one(spark, calendar.iso_weekday(date("2026-11-30"))) == 1
    assert one(spark, calendar.iso_weekday(date("2200-01-01"))) == 3
    parts = spark.range(1).select(date("2026-11-30").alias("d")).select(*calendar.date_parts("d", True, True))
    assert tuple(parts.first()) == (2026, 11, 30, 0)


@pytest.mark.parametrize(
    ("day", "days"), [("2016-02-10", 28), ("2019-04-30", 30), ("2019-12-01", 31), ("2019-01-31", 31)]
)
def test_fixed_month_days(spark, day, days):
    assert one(spark, calendar.fixed_month_days(date(day))) == days


@pytest.mark.parametrize(
    ("audit", "due"),
    [("2019-02-28", "2019-03-28"), ("2019-03-31", "2019-05-01"), ("2019-04-05", "2019-05-05"), ("2019-06-05",) * 2],
)
def test_forecast_due_date(spark, audit, due):
    assert one(spark, calendar.forecast_due_date(date(audit))) == dt.date.fromisoformat(due)


@pytest.mark.parametrize(("day", "flags"), [(1, (1, 0, 0)), (9, (1, 0, 0)), (10, (0, 1, 0)), (20, (0, 0, 1))])
def test_month_thirds(spark, day, flags):
    out = spark.range(1).select(*calendar.month_third_flags(F.lit(day)).values()).first()
    assert tuple(out) == flags


def test_class_edges(spark):
    principal = [(1170, 6), (1171, 5), (2260, 5), (3350, 4), (3910, 3), (5540, 2), (5541, 1), (None, None)]
    for value, expected in principal:
        assert one(spark, classes.principal_class(F.lit(value).cast("int"))) == expected
    for value, expected in [(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (8, 4), (9, 5), (100, 5)]:
        assert one(spark, classes.loan_times_class(F.lit(value))) == expected


def test_equal_width_class_with_small_range(spark):
    low, high = F.lit(7), F.lit(9)
    assert [one(spark, classes.equal_width_class(F.lit(n), low, high)) for n in (7, 8, 9)] == [1, 2, 3]
    low, high = F.lit(0), F.lit(53)
    assert [one(spark, classes.equal_width_class(F.lit(n), low, high)) for n in (0, 10, 53)] == [1, 2, 6]


def test_null_and_sentinel_flags(spark):
    null = F.lit(None).cast("string")
    assert one(spark, classes.same_flag(null, null)) == 0
    assert one(spark, classes.same_flag(F.lit("\\N"), F.lit("\\N"))) == 1
    assert one(spark, classes.repaid_flag(date("2200-01-01"))) == 0
    assert one(spark, classes.repaid_flag(date("2018-01-01"))) == 1
    assert one(spark, classes.clamp_days(F.lit(None).cast("int"))) == -1
    assert one(spark, classes.clamp_days(F.lit(-3))) == -1
    assert one(spark, classes.clamp_days(F.lit(0))) == 0
    assert one(spark, classes.gender_code(F.lit(" 男"))) == 1
    assert one(spark, classes.gender_code(null)) == 0
    assert one(spark, classes.known_city(F.lit("\\N"))) == "c0"


def test_class_probability_index(spark):
    probabilities = F.array(*[F.lit(float(i)) for i in range(33)])
    for index, expected in [(-1, 32.0), (0, 0.0), (32, 32.0), (33, None), (-2, None)]:
        assert one(spark, classes.class_probability(probabilities, F.lit(index))) == expected
    assert one(spark, classes.argmax(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.5)))) == 1


@pytest.mark.parametrize("mean", [0.99499, 0.98, 0.995, 1.0, 5.5, 22.994, 22.996, 11.123])
def test_hour_bucket_follows_float_floor_division(spark, mean):
    expected = int(((mean + 0.00501) // 0.01) // 100)
    assert one(spark, classes.hour_bucket(F.lit(mean))) == expected


LABEL_ROWS = [
    # repay_date, repay_amt and the label under canonical, integration, feature_only, exploration
    ("2018-02-10", "9.5", (0, 0, 0, 0)),
    ("2018-02-03", "9.5", (7, 7, 7, 7)),
    ("2018-01-10", "9.5", (31, 31, 31, 32)),
    ("2018-01-10", "0", (32, 32, 31, 32)),
    ("\\N", "\\N", (32, 32, -1, -1)),
    (None, "9.5", (None, None, None, None)),
]


@pytest.mark.parametrize("position", range(4))
def test_label_variants(spark, position):
    rule = ("canonical", "integration", "feature_only", "exploration")[position]
    rows = [(i, r[0], r[1]) for i, r in enumerate(LABEL_ROWS)]
    train = spark.createDataFrame(rows, "id int, repay_date string, repay_amt string").select(
        "*", date("2018-01-10").alias("auditing_date"), date("2018-02-10").alias("due_date")
    )
    out = {r["id"]: r["label"] for r in with_label(train, rule).collect()}
    assert out == {i: r[2][position] for i, r in enumerate(LABEL_ROWS)}
