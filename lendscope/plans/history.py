"""Repayment-log base columns and history statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.calendar import iso_weekday, month_third_flags
from lendscope.functions.classes import clamp_days, repaid_flag
from lendscope.operators.quantiles import grouped_medians
from lendscope.operators.stats import (
    adjusted_skewness,
    excess_kurtosis,
    grain_stats,
    value_range,
)

RATE_KEY = "decimal(12,4)"
AMOUNT_KEY = "decimal(14,2)"

MEAN_STD = ("mean", "std")
USER_MEASURES = {
    "u_early_repay_days": ("early_repay_days", ("max", "mode", "min", "mean", "std")),
    "u_repay_due_weekday": ("due_weekday", ("mode", "mean", "std")),
    "u_repay_weekday": ("repay_weekday", MEAN_STD),
    "u_repay": ("repay", MEAN_STD),
}


def grain_measures(prefix: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Repaid share and early days, mean and deviation, under a grain's prefix."""
    return {
        f"{prefix}_repay": ("repay", MEAN_STD),
        f"{prefix}_early_repay_days": ("early_repay_days", MEAN_STD),
    }


def with_repayment(log: DataFrame) -> DataFrame:
    """Repaid flag and days repaid early, -1 when late or unpaid."""
    return log.withColumns(
        {
            "repay": repaid_flag(F.col("repay_date")),
            "early_repay_days": clamp_days(F.datediff("due_date", "repay_date")),
        }
    )


def first_order_log(log: DataFrame) -> DataFrame:
    """First instalments with repayment and calendar columns."""
    day = F.dayofmonth("due_date")
    return with_repayment(log.filter(F.col("order_id") == 1)).withColumns(
        {
            "due_month": F.month("due_date"),
            "due_day": day,
            "due_weekday": iso_weekday(F.col("due_date")),
            "repay_weekday": iso_weekday(F.col("repay_date")),
            **month_third_flags(day),
        }
    )


def attach_rate(log: DataFrame, listing: DataFrame) -> DataFrame:
    """The listing's rate as a decimal key, so that it can be grouped and joined on."""
    rates = listing.select("user_id", "listing_id", F.col("rate").cast(RATE_KEY).alias("rate"))
    return log.join(rates, ["user_id", "listing_id"], "left")


def user_stats(first_log: DataFrame) -> DataFrame:
    return grain_stats(first_log, ["user_id"], USER_MEASURES)


def user_month_stats(first_log: DataFrame) -> DataFrame:
    return grain_stats(first_log, ["user_id", "due_month"], grain_measures("u_dm"))


def user_weekday_stats(first_log: DataFrame) -> DataFrame:
    return grain_stats(first_log, ["user_id", "due_weekday"], grain_measures("u_dw"))


def user_rate_stats(rated_log: DataFrame) -> DataFrame:
    return grain_stats(rated_log, ["user_id", "rate"], grain_measures("u_r"))


def user_amount_stats(first_log: DataFrame) -> DataFrame:
    """By repaid amount. For exploration only: the amount is the model's own target."""
    keyed = first_log.withColumn("repay_amt", F.col("repay_amt").cast(AMOUNT_KEY))
    return grain_stats(keyed, ["user_id", "repay_amt"], grain_measures("u_ra"))


def _order_moments(base: DataFrame, suffix: str) -> DataFrame:
    days, amount = "early_repay_days", "due_amt"
    statistics: dict[str, Column] = {
        "repay_mean": F.avg("repay"),
        "early_repay_days_max": F.max(days),
        "early_repay_days_sum": F.sum(days),
        "early_repay_days_mean": F.avg(days),
        "early_repay_days_std": F.stddev_samp(days),
        "due_amt_max": F.max(amount),
        "due_amt_min": F.min(amount),
        "due_amt_mean": F.avg(amount),
        "due_amt_sum": F.sum(amount),
        "due_amt_std": F.stddev_samp(amount),
        "due_amt_skew": adjusted_skewness(amount),
        "due_amt_kurt": excess_kurtosis(amount),
        "due_amt_ptp": value_range(amount),
    }
    return base.groupBy("user_id").agg(*[column.alias(name + suffix) for name, column in statistics.items()])


def order_distribution(
    log: DataFrame, suffix: str = "", medians: Callable[..., DataFrame] = grouped_medians
) -> DataFrame:
    """Fifteen distribution statistics per user over the given instalments.

    Moments are combined within map tasks; ``medians`` need the rows of a user in
    order and are found separately, on the same partitioning by user.
    """
    base = with_repayment(log).filter(F.col("user_id").isNotNull())
    middle = {
        "early_repay_days_median" + suffix: "early_repay_days",
        "due_amt_median" + suffix: "due_amt",
    }
    return _order_moments(base, suffix).join(medians(base, "user_id", middle), "user_id", "left")


def _mean(prefix: str, rows: str = "rows") -> str:
    return f"{prefix}_s / {rows}"


def _std(prefix: str, rows: str = "rows") -> str:
    """Sample standard deviation from exact sums, 0 for one row."""
    spread = f"greatest({prefix}_ss - double({prefix}_s) * {prefix}_s / {rows}, 0D)"
    return f"CASE WHEN {rows} > 1 THEN sqrt({spread} / ({rows} - 1)) ELSE 0D END"


def _grain_map(grain: str) -> Column:
    """Map from a grain's key to its statistics, over the cells of one user."""
    return F.expr(f"""
        map_from_entries(collect_list(struct(key, struct(
            {_mean("repay")} AS u_{grain}_repay_mean, {_std("repay")} AS u_{grain}_repay_std,
            {_mean("early")} AS u_{grain}_early_repay_days_mean,
            {_std("early")} AS u_{grain}_early_repay_days_std)))
            FILTER (WHERE grain = '{grain}' AND key IS NOT NULL))""").alias(grain)


def user_history(first_log: DataFrame) -> DataFrame:
    """The order-1 history of a user in one row, for a single join to the fact.

    Each log row goes to one cell per grain: its month, weekday and days early.
    Cells are summed within map tasks before the shuffle, and a user has few of
    them, so the second step, which turns them into maps (``dm``, ``dw``) and
    user totals, is small for every user. Days, weekdays and flags are integers,
    so the sums behind the means and deviations are exact. Rates have no bounded
    number per user and stay out of its row (``user_rate_stats``).
    """
    grains = {"dm": "due_month", "dw": "due_weekday", "days": "early_repay_days"}
    keys = F.array(
        *[
            F.struct(F.lit(grain).alias("grain"), F.col(column).cast("int").alias("key"))
            for grain, column in grains.items()
        ]
    )
    cells = (
        first_log.filter(F.col("user_id").isNotNull())
        .selectExpr(
            "user_id",
            "bigint(early_repay_days) AS early",
            "bigint(repay_weekday) AS weekday",
            "repay",
            "due_month",
            "due_weekday",
            "early_repay_days",
        )
        .select("user_id", "early", "weekday", "repay", F.inline(keys))
        .groupBy("user_id", "grain", "key")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("weekday").alias("weekday_rows"),
            F.sum("repay").alias("repay_s"),
            F.sum("repay").alias("repay_ss"),
            F.sum("early").alias("early_s"),
            F.expr("sum(early * early)").alias("early_ss"),
            F.sum("weekday").alias("weekday_s"),
            F.expr("sum(weekday * weekday)").alias("weekday_ss"),
            F.max("early").alias("early_max"),
            F.min("early").alias("early_min"),
        )
    )
    # Every row is in exactly one month cell, so those add up to the user's totals.
    sums = ["rows", "weekday_rows"]
    sums += [f"{measure}_{part}" for measure in ("repay", "early", "weekday") for part in ("s", "ss")]
    per_user = cells.groupBy("user_id").agg(
        _grain_map("dm"),
        _grain_map("dw"),
        *[F.expr(f"sum({name}) FILTER (WHERE grain = 'dm')").alias(name) for name in sums],
        F.max("early_max").cast("int").alias("u_early_repay_days_max"),
        F.min("early_min").cast("int").alias("u_early_repay_days_min"),
        *[
            F.expr(
                f"max_by(key, struct(rows, -key)) FILTER (WHERE grain = '{grain}' AND key IS NOT NULL)"
            ).alias(name)
            for grain, name in (("days", "u_early_repay_days_mode"), ("dw", "u_repay_due_weekday_mode"))
        ],
        F.expr("sum(rows) FILTER (WHERE grain = 'dw' AND key IS NOT NULL)").alias("due_rows"),
        F.expr("sum(rows * key) FILTER (WHERE grain = 'dw')").alias("due_s"),
        F.expr("sum(rows * key * key) FILTER (WHERE grain = 'dw')").alias("due_ss"),
    )
    return per_user.selectExpr(
        "user_id",
        "rows AS freq",
        "early_s AS early_days_sum",
        "early_ss AS early_days_squares",
        "u_early_repay_days_max",
        "u_early_repay_days_mode",
        "u_early_repay_days_min",
        f"{_mean('early')} AS u_early_repay_days_mean",
        f"{_std('early')} AS u_early_repay_days_std",
        "u_repay_due_weekday_mode",
        f"{_mean('due', 'due_rows')} AS u_repay_due_weekday_mean",
        f"{_std('due', 'due_rows')} AS u_repay_due_weekday_std",
        f"{_mean('weekday', 'weekday_rows')} AS u_repay_weekday_mean",
        f"{_std('weekday', 'weekday_rows')} AS u_repay_weekday_std",
        f"{_mean('repay')} AS u_repay_mean",
        f"{_std('repay')} AS u_repay_std",
        "dm",
        "dw",
    )
