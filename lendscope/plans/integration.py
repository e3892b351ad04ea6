"""The integration feature table: first-instalment and all-instalment distributions, place codes and dates per listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.calendar import date_parts
from lendscope.operators.encoding import indicator_rows, with_codes
from lendscope.operators.quantiles import hot_medians, ordinary_medians
from lendscope.operators.skew import hot_by_count, left_join_spread
from lendscope.plans.facts import amount_per_loan_day, fact_table
from lendscope.plans.feature_table import LendingTables, stored_log
from lendscope.plans.history import order_distribution
from lendscope.plans.users import latest_profiles
from lendscope.session import cut_lineage
from lendscope.sources.bucketed import KeyedTable

PLACES = ("cell_province", "id_province", "id_city")
LISTING = ("user_id", "listing_id", "auditing_date")


def distributions(log: KeyedTable) -> DataFrame:
    """Per user fifteen statistics of first instalments and, suffixed, of all instalments; nothing is shuffled for them."""

    def of(rows: DataFrame, medians) -> DataFrame:
        first = order_distribution(rows.filter(F.col("order_id") == 1), "", medians)
        return order_distribution(rows, "_all_order", medians).join(first, "user_id", "left")

    return log.per_key(lambda rows: of(rows, ordinary_medians), lambda rows: of(rows, hot_medians))


def place_codes(user_info: DataFrame) -> DataFrame:
    """Newest profile per user with a code per place, in the order in which users first show it."""
    profiles = latest_profiles(user_info).select("user_id", "reg_mon", "gender", *PLACES, "info_insert_date")
    return with_codes(profiles, PLACES, F.col("user_id"), "user_id")


def integration_table(tables: LendingTables) -> DataFrame:
    """One row per train and test listing; keys, label and numeric columns.

    All user columns are joined to one row per user first, so the fact is shuffled to its user once;
    a user with very many listings is spread over salts.
    """
    log = stored_log(tables)
    tags = tables.user_taglist.groupBy("user_id").agg(F.max("insertdate").alias("tag_insert_date"))
    fact = fact_table(tables.train, tables.test, "integration")
    counts = cut_lineage(fact.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows")))
    per_user = counts.select("user_id")
    for part in (place_codes(tables.user_info), tags, distributions(log)):
        per_user = per_user.join(part, "user_id", "left")
    terms = tables.listing_info.select(*LISTING, "term", "rate", "principal")
    joined = left_join_spread(
        fact.join(terms, list(LISTING), "left"), per_user, "user_id", "listing_id", hot=hot_by_count(counts, "user_id", "_rows")
    )
    numeric = [
        "is_train", "label", "due_amt", "term", "rate", "principal", "gender", *[f"{p}_code" for p in PLACES], "due_amt_per_days",
    ]
    statistics = [c for c in per_user.columns if c.startswith(("repay_mean", "early_repay_days", "due_amt"))]
    parts = [
        *date_parts("auditing_date", day=True),
        *date_parts("due_date", day=True),
        *date_parts("reg_mon", year=True),
        *date_parts("info_insert_date", year=True, day=True),
        *date_parts("tag_insert_date", year=True, day=True),
    ]
    return amount_per_loan_day(joined).select("user_id", "listing_id", *numeric, *statistics, *parts)


def integration_indicators(tables: LendingTables) -> DataFrame:
    """The place codes of each listing as indicators in long form."""
    codes = place_codes(tables.user_info).select("user_id", *[F.col(f"{p}_code").alias(p) for p in PLACES])
    fact = tables.train.select("user_id", "listing_id").union(tables.test.select("user_id", "listing_id"))
    return indicator_rows(left_join_spread(fact, codes, "user_id", "listing_id"), "listing_id", PLACES)
