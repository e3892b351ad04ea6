"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(date: Column) -> Column:
    """Monday 1 … Sunday 7."""
    return F.weekday(date) + 1


def fixed_month_days(date: Column) -> Column:
    """Length of the month of ``date``, February always 28."""
    return F.when(F.month(date) == 2, 28).otherwise(F.dayofmonth(F.last_day(date)))


def month_third_flags(day: Column) -> dict[str, Column]:
    """0/1 flags for the first, middle and last third of the month."""
    return {
        "early_month": F.when(day < 10, 1).otherwise(0),
        "median_month": F.when((day >= 10) & (day < 20), 1).otherwise(0),
        "last_month": F.when(day >= 20, 1).otherwise(0),
    }


def date_parts(column: str, year: bool = False, day: bool = False) -> list[Column]:
    """Month of a date column, and on request its year, day and weekday (Monday 0)."""
    date = F.col(column)
    parts = [F.month(date).alias(f"{column}_month")]
    if year:
        parts.insert(0, F.year(date).alias(f"{column}_year"))
    if day:
        parts += [
            F.dayofmonth(date).alias(f"{column}_day"),
            F.weekday(date).alias(f"{column}_dayofweek"),
        ]
    return parts


# Days between audit and due date for listings audited in month 2, 3, 4.
FORECAST_MONTH_DAYS = {2: 28, 3: 31, 4: 30}


def forecast_due_date(auditing_date: Column) -> Column:
    """Due date of a test listing; other months keep the audit date.

    A fixed number of days, not a calendar month: 2019-03-31 becomes 2019-05-01.
    """
    days = F.lit(0)
    for month, length in FORECAST_MONTH_DAYS.items():
        days = F.when(F.month(auditing_date) == month, length).otherwise(days)
    return F.date_add(auditing_date, days)
