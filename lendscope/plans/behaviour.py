"""Profile of the behaviour log by type, weekday, month, year and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.classes import hour_bucket
from lendscope.operators.profiling import dense_counts, dense_share, describe_by
from lendscope.operators.numbering import positional_slice

BEHAVIOUR_TYPES = (1, 2, 3)


def with_time_parts(log: DataFrame) -> DataFrame:
    time = F.col("behavior_time")
    return log.withColumns(
        {
            "weekday": F.weekday(time),
            "month": F.month(time),
            "year": F.year(time),
            "hour": F.hour(time),
        }
    )


def weekday_share(log: DataFrame) -> DataFrame:
    """Share of each weekday, Monday 0, within its behaviour type."""
    return dense_share(with_time_parts(log), "behavior_type", BEHAVIOUR_TYPES, "weekday", 0, 6)


def month_share(log: DataFrame) -> DataFrame:
    """Share of each month within its behaviour type."""
    return dense_share(with_time_parts(log), "behavior_type", BEHAVIOUR_TYPES, "month", 1, 12)


def describe_years(log: DataFrame) -> DataFrame:
    """Description of the numeric columns for each year."""
    return describe_by(with_time_parts(log), "year", ["user_id", "behavior_type", "weekday", "month"])


def describe_types(log: DataFrame) -> DataFrame:
    """Description of the calendar columns for each behaviour type."""
    return describe_by(with_time_parts(log), "behavior_type", ["weekday", "month", "year", "hour"])


def describe_all(log: DataFrame) -> DataFrame:
    """Description of the numeric columns over the whole log."""
    whole = with_time_parts(log).withColumn("rows_of", F.lit("all"))
    columns = ["user_id", "behavior_type", "weekday", "month", "year", "hour"]
    return describe_by(whole, "rows_of", columns).drop("rows_of")


def describe_mean_hours(log: DataFrame) -> DataFrame:
    """Description of the users' mean hours and of their whole-hour buckets."""
    hours = user_mean_hours(log).select(
        F.lit("all").alias("rows_of"), "hour_mean", hour_bucket(F.col("hour_mean")).alias("hour_bucket")
    )
    return describe_by(hours, "rows_of", ["hour_mean", "hour_bucket"]).drop("rows_of")


def hour_histogram(log: DataFrame) -> DataFrame:
    """Rows per hour of the day."""
    return dense_counts(with_time_parts(log), "hour", 0, 23)


def user_mean_hours(log: DataFrame) -> DataFrame:
    """Mean hour of each user's behaviour."""
    hours = with_time_parts(log).filter(F.col("user_id").isNotNull())
    return hours.groupBy("user_id").agg(F.avg("hour").alias("hour_mean"))


def user_mean_hour_histogram(log: DataFrame) -> DataFrame:
    """Users per whole hour of their mean hour."""
    buckets = user_mean_hours(log).select(hour_bucket(F.col("hour_mean")).alias("hour"))
    return dense_counts(buckets, "hour", 0, 23)


def users_per_row(log: DataFrame) -> DataFrame:
    """Distinct users, rows and their ratio."""
    return log.agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows")
    ).withColumn("users_per_row", F.try_divide(F.col("users"), F.col("rows")))


def log_slice(log: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows [start, stop) in time order, users and types breaking ties."""
    return positional_slice(log, ["behavior_time", "user_id", "behavior_type"], start, stop)
