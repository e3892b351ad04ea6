"""Scalar classes, codes and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendscope.sources.files import MISSING_TEXT

# Upper bounds of principal and the class at or below each bound.
PRINCIPAL_BOUNDS = ((1170, 6), (2260, 5), (3350, 4), (3910, 3), (5540, 2))
# Upper bounds of the loan count and the class at or below each bound.
LOAN_COUNT_BOUNDS = ((1, 1), (2, 2), (4, 3), (8, 4))
UNKNOWN_CITY = "c0"
# Fixed value: the repayment date that marks an unpaid instalment.
UNPAID_DATE = "2200-01-01"


def step_class(value: Column, bounds: tuple[tuple[int, int], ...], above: int) -> Column:
    """Class of the first bound that ``value`` does not exceed; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for bound, code in bounds:
        out = out.when(value <= bound, code)
    return out.otherwise(above)


def principal_class(principal: Column) -> Column:
    return step_class(principal, PRINCIPAL_BOUNDS, above=1)


def loan_times_class(count: Column) -> Column:
    return step_class(count, LOAN_COUNT_BOUNDS, above=5)


def equal_width_class(count: Column, low: Column, high: Column) -> Column:
    """1 … 7 by fifths of the range; a range below five falls back to unit steps."""
    width = F.greatest(F.floor((high - low) / 5), F.lit(1))
    return (F.least(F.lit(6), F.floor((count - low) / width)) + 1).cast("int")


def gender_code(gender: Column) -> Column:
    return F.when(F.trim(gender) == "男", 1).otherwise(0)


def known_city(city: Column) -> Column:
    return F.replace(city, F.lit(MISSING_TEXT), F.lit(UNKNOWN_CITY))


def same_flag(left: Column, right: Column) -> Column:
    """1 where both sides are equal; a null on either side gives 0."""
    return F.when(left == right, 1).otherwise(0)


def repaid_flag(repay_date: Column) -> Column:
    """0 for the date that marks an unpaid instalment; a missing date counts as repaid."""
    return F.when(repay_date == F.lit(UNPAID_DATE).cast("date"), 0).otherwise(1)


def clamp_days(days: Column) -> Column:
    """Negative and missing become -1."""
    return F.when(days >= 0, days).otherwise(-1)


def hour_bucket(mean_hour: Column) -> Column:
    """Round to a hundredth by float floor division, then take the whole hour.

    The remainder form is needed: 1.0 holds only 99 whole steps of 0.01 in
    binary floating point, which a plain floor of the quotient misses.
    """
    shifted = mean_hour + 0.00501
    hundredths = F.round((shifted - shifted % 0.01) / 0.01)
    return F.floor(hundredths / 100).cast("int")


def class_probability(probabilities: Column, index: Column) -> Column:
    """Probability of a class; index -1 means the last class, others outside give null."""
    last = F.size(probabilities) - 1
    return F.get(probabilities, F.when(index == -1, last).otherwise(index))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
