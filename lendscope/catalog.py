"""Named queries over the test tables, one or more per operator of the inventory."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions import calendar
from lendscope.functions.calendar import date_parts
from lendscope.functions.classes import UNPAID_DATE
from lendscope.functions.labels import LABEL_RULES, with_label
from lendscope.operators import encoding, numbering, profiling, ranking
from lendscope.plans import behaviour, facts, forecast, history, integration, listings, metrics, sparse_input, tags, tiers, users
from lendscope.plans import feature_table as features
from lendscope.plans.feature_table import Derived, LendingTables
from lendscope.plans.model import CrossValidation, audit
from lendscope.session import shared_folder
from lendscope.sources import files
from lendscope.sources.lending_views import LendingViews, fixed_probabilities

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Dates of the exploratory predicates, moved into the date range of the test tables.
RANGE_DATE = "1999-03-01"
LATE_DATE = "2001-04-01"


# Integer features that are missing on test rows or for users without history.
NULLABLE_FEATURES = [
    "label",
    "repay_weekday",
    "freq",
    "most_freq",
    "median_freq",
    "lower_freq",
    "u_early_repay_days_max",
    "u_early_repay_days_mode",
    "u_early_repay_days_min",
    "u_repay_due_weekday_mode",
]


def query(build: Callable[[LendingViews], DataFrame]) -> Callable[[LendingViews], DataFrame]:
    """Register a plan under its function's name, its columns made comparable.

    The plan itself stays available as the registered function's ``plan``.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(build(LendingViews(spark, folder)))

    run.plan = lambda spark, folder: build(LendingViews(spark, folder))
    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


# How a column is shown for comparison between engines, by Spark type. Doubles are
# rounded by plain arithmetic, which is far cheaper than a decimal round.
COMPARABLE = {
    "double": "floor({0} * 1000000D + 0.5D) / 1000000D AS {0}",
    "date": "CAST({0} AS string) AS {0}",
    "timestamp_ntz": "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {0}",
}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, dates and times as text."""
    return df.selectExpr(*[COMPARABLE.get(dtype, "{0}").format(f"`{name}`") for name, dtype in df.dtypes])


def shown_as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns with missing values as doubles, which every client reads alike."""
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


def _fact(v: LendingViews) -> DataFrame:
    return facts.fact_table(v.train(), v.test())


def _first_log(v: LendingViews) -> DataFrame:
    return history.first_order_log(v.user_repay_logs())


def _rated_log(v: LendingViews) -> DataFrame:
    return history.attach_rate(_first_log(v), v.listing_info())


def _tables(v: LendingViews) -> LendingTables:
    stored = v.stored()
    frames = {name: getattr(v, name)() for name in stored}
    return LendingTables(**frames, derived=tuple(Derived(frames[name], stored[name]) for name in stored))


def _tiered(v: LendingViews) -> DataFrame:
    activity = tiers.user_activity(_first_log(v))
    return tiers.with_tier(activity, tiers.TierBounds.quartiles(activity))


def _folded(v: LendingViews) -> DataFrame:
    return ranking.stratified_folds(with_label(v.train()), "label", "listing_id")


# Labels, union, calendar


@query
def label_days_early(v: LendingViews) -> DataFrame:
    return with_label(v.train()).select("listing_id", "repay_date", "repay_amt", "label")


@query
def label_variants(v: LendingViews) -> DataFrame:
    labelled = v.train().withColumns({"_date": F.col("repay_date"), "_amt": F.col("repay_amt")})
    for rule in LABEL_RULES:
        labelled = with_label(
            labelled.withColumns({"repay_date": F.col("_date"), "repay_amt": F.col("_amt")}),
            rule,
            f"label_{rule}",
        )
    return labelled.select("listing_id", *[f"label_{rule}" for rule in LABEL_RULES])


@query
def label_distribution(v: LendingViews) -> DataFrame:
    return profiling.value_counts(with_label(v.train()), "label")


@query
def label_ranking(v: LendingViews) -> DataFrame:
    """Label counts with their place in the sorted output; there are 33 labels at most."""
    counts = with_label(v.train()).filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "label", "n")))
    return counts.agg(ordered.alias("rows")).select(F.posexplode("rows").alias("position", "row")).select(
        F.col("position").cast("long").alias("position"), "row.label", "row.n"
    )


@query
def label_count_histogram(v: LendingViews) -> DataFrame:
    counts = with_label(v.train()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return profiling.equal_width_histogram(counts, "n", 32)


@query
def train_test_union(v: LendingViews) -> DataFrame:
    return shown_as_double(_fact(v), "label", "repay_weekday")


@query
def train_test_split_counts(v: LendingViews) -> DataFrame:
    train, test = facts.split_fact(_fact(v))
    parts = [part.groupBy("is_train").agg(F.count(F.lit(1)).alias("n")) for part in (train, test)]
    return parts[0].unionByName(parts[1])


@query
def calendar_parts(v: LendingViews) -> DataFrame:
    return shown_as_double(_fact(v), "repay_weekday").select(
        "listing_id",
        "due_weekday",
        "repay_weekday",
        *date_parts("auditing_date", day=True),
        *date_parts("due_date", day=True),
    )


@query
def user_date_parts(v: LendingViews) -> DataFrame:
    newest = ranking.latest_per_key(v.user_info(), "user_id", "insertdate")
    return newest.select(
        "user_id", *date_parts("reg_mon", year=True), *date_parts("insertdate", year=True, day=True)
    )


@query
def month_third_flags(v: LendingViews) -> DataFrame:
    return _first_log(v).select(
        "user_id",
        "listing_id",
        "due_month",
        "due_day",
        "due_weekday",
        "repay_weekday",
        "early_month",
        "median_month",
        "last_month",
    )


@query
def fixed_month_days(v: LendingViews) -> DataFrame:
    return v.listing_info().select(
        "listing_id", calendar.fixed_month_days(F.col("auditing_date")).alias("auditing_date_days")
    )


@query
def amount_per_loan_day(v: LendingViews) -> DataFrame:
    return facts.amount_per_loan_day(_fact(v)).select("listing_id", "is_train", "due_amt_per_days")


# Listings and users


@query
def listing_ratios(v: LendingViews) -> DataFrame:
    return listings.listing_features(v.listing_info()).select("listing_id", "principal_per_term", "TermRate")


@query
def principal_class(v: LendingViews) -> DataFrame:
    return (
        listings.listing_features(v.listing_info())
        .groupBy("principal", "principal_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def loan_times_class(v: LendingViews) -> DataFrame:
    return listings.user_loan_stats(v.listing_info()).select("user_id", "loan_times", "loan_times_type")


@query
def listing_features(v: LendingViews) -> DataFrame:
    return listings.join_listing(_fact(v), v.listing_info()).select(
        "listing_id",
        "is_train",
        "term",
        "rate",
        "principal",
        "auditing_date_month",
        "auditing_date_days",
        "principal_per_term",
        "principal_class",
        "TermRate",
    )


@query
def user_principal_stats(v: LendingViews) -> DataFrame:
    return listings.user_loan_stats(v.listing_info()).select("user_id", "mean_principal", "std_principal")


@query
def user_latest(v: LendingViews) -> DataFrame:
    return ranking.latest_per_key(v.user_info(), "user_id", "insertdate")


@query
def city_class(v: LendingViews) -> DataFrame:
    return users.city_classes(users.latest_profiles(v.user_info()))


@query
def user_profile_features(v: LendingViews) -> DataFrame:
    return users.profile_features(v.user_info())


# Repayment history


@query
def user_repay_stats(v: LendingViews) -> DataFrame:
    return history.user_stats(_first_log(v)).select(
        "user_id", *[f"u_early_repay_days_{s}" for s in ("max", "mode", "min", "mean", "std")]
    )


@query
def user_due_weekday_stats(v: LendingViews) -> DataFrame:
    return history.user_stats(_first_log(v)).select(
        "user_id", *[f"u_repay_due_weekday_{s}" for s in ("mode", "mean", "std")]
    )


@query
def user_repay_weekday_stats(v: LendingViews) -> DataFrame:
    return history.user_stats(_first_log(v)).select(
        "user_id", "u_repay_weekday_mean", "u_repay_weekday_std"
    )


@query
def user_repay_rate(v: LendingViews) -> DataFrame:
    return history.user_stats(_first_log(v)).select("user_id", "u_repay_mean", "u_repay_std")


@query
def user_month_stats(v: LendingViews) -> DataFrame:
    return history.user_month_stats(_first_log(v))


@query
def user_weekday_stats(v: LendingViews) -> DataFrame:
    return history.user_weekday_stats(_first_log(v))


@query
def user_rate_stats(v: LendingViews) -> DataFrame:
    return history.user_rate_stats(_rated_log(v)).withColumn("rate", F.col("rate").cast("double"))


@query
def user_amount_stats(v: LendingViews) -> DataFrame:
    return history.user_amount_stats(_first_log(v)).withColumn(
        "repay_amt", F.col("repay_amt").cast("double")
    )


@query
def first_order_distribution(v: LendingViews) -> DataFrame:
    return history.order_distribution(v.user_repay_logs().filter(F.col("order_id") == 1))


@query
def all_order_distribution(v: LendingViews) -> DataFrame:
    return history.order_distribution(v.user_repay_logs(), "_all_order")


@query
def repay_log_after_date(v: LendingViews) -> DataFrame:
    return v.user_repay_logs().filter(F.col("due_date") > F.lit(RANGE_DATE).cast("date"))


@query
def repay_log_late_repaid(v: LendingViews) -> DataFrame:
    repaid = F.col("repay_date")
    return v.user_repay_logs().filter(
        (repaid >= F.lit(LATE_DATE).cast("date")) & (repaid != F.lit(UNPAID_DATE).cast("date"))
    )


@query
def repay_log_never_repaid(v: LendingViews) -> DataFrame:
    return v.user_repay_logs().filter(F.col("repay_date") == F.lit(UNPAID_DATE).cast("date"))


@query
def repay_log_order_counts(v: LendingViews) -> DataFrame:
    recent = v.user_repay_logs().filter(F.col("repay_date") > F.lit(RANGE_DATE).cast("date"))
    return profiling.value_counts(recent, "order_id")


@query
def date_ranges(v: LendingViews) -> DataFrame:
    sources = [
        ("train_auditing", v.train(), "auditing_date"),
        ("test_auditing", v.test(), "auditing_date"),
        ("listing_auditing", v.listing_info(), "auditing_date"),
        ("log_due", v.user_repay_logs(), "due_date"),
    ]
    ranges = [
        df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date")).withColumn("source", F.lit(name))
        for name, df, c in sources
    ]
    out = ranges[0]
    for part in ranges[1:]:
        out = out.unionByName(part)
    return out


@query
def weekday_counts(v: LendingViews) -> DataFrame:
    labelled = facts.split_fact(_fact(v))[0]
    parts = [
        profiling.value_counts(labelled, name).select(
            F.lit(name).alias("date"), F.col(name).alias("weekday"), "n"
        )
        for name in ("due_weekday", "repay_weekday")
    ]
    return parts[0].unionByName(parts[1])


@query
def listing_slice(v: LendingViews) -> DataFrame:
    return numbering.positional_slice(v.listing_info(), ["listing_id"], 1, 100_000)


@query
def repay_log_slice(v: LendingViews) -> DataFrame:
    # The log has no unique key: equal instalments follow each other by their other columns.
    order = ["listing_id", "order_id", "due_date", "due_amt", "repay_date", "repay_amt"]
    return numbering.positional_slice(v.user_repay_logs(), order, 1, 100_000)


@query
def user_lookup(v: LendingViews) -> DataFrame:
    """All rows of one user, the one with the smallest id in the test set."""
    user = v.test().agg(F.min("user_id")).scalar()
    sources = {"listing": v.listing_info(), "log": v.user_repay_logs(), "test": v.test()}
    return ranking.rows_of(sources, "user_id", user, ["listing_id"])


@query
def users_in_listing(v: LendingViews) -> DataFrame:
    known = v.user_info().select("user_id").distinct()
    return ranking.with_membership(known, v.listing_info(), "user_id", "in_listing")


@query
def log_non_null_shares(v: LendingViews) -> DataFrame:
    return profiling.non_null_shares(v.user_repay_logs(), "order_id")


@query
def column_profile(v: LendingViews) -> DataFrame:
    return profiling.column_profile(_rated_log(v))


@query
def csv_round_trip(v: LendingViews) -> DataFrame:
    """Tables written as CSV, read back with broken rows set apart, and compared."""
    folder = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    tables = {
        "train": v.train(), "test": v.test(), "listing_info": v.listing_info(), "user_info": v.user_info(),
        "user_repay_logs": v.user_repay_logs(),
    }
    return reduce(DataFrame.unionByName, [files.round_trip(df, name, folder) for name, df in tables.items()])


def _sorted_forecast(v: LendingViews) -> numbering.PositionIndex:
    scored = v.test().withColumn("probabilities", fixed_probabilities(F.col("listing_id")))
    daily = forecast.daily_forecast(v.submission(), scored)
    order = ["listing_id", "repay_date"]
    index = numbering.PositionIndex.build(daily, [F.col(c) for c in order])
    index.check_order(order)
    return index


@query
def sorted_forecast(v: LendingViews) -> DataFrame:
    """The daily forecast in order, with each row's position in it."""
    return _sorted_forecast(v).positioned()


@query
def forecast_preview(v: LendingViews) -> DataFrame:
    return _sorted_forecast(v).preview(20)


# Tiers


@query
def frequency_tiers_quantile(v: LendingViews) -> DataFrame:
    return _tiered(v).select("user_id", "freq", "most_freq", "median_freq", "lower_freq")


@query
def frequency_tiers_fixed(v: LendingViews) -> DataFrame:
    activity = tiers.user_activity(_first_log(v))
    return tiers.with_tier(activity, tiers.TierBounds.fixed()).select(
        "user_id", "freq", "most_freq", "median_freq", "lower_freq"
    )


@query
def tier_stats(v: LendingViews) -> DataFrame:
    return tiers.tier_stats(_tiered(v))


@query
def tier_amount_stats(v: LendingViews) -> DataFrame:
    return tiers.tier_amount_stats(_first_log(v), _tiered(v)).withColumn(
        "repay_amt", F.col("repay_amt").cast("double")
    )


@query
def tier_amount_stats_fixed(v: LendingViews) -> DataFrame:
    first_log = _first_log(v)
    tiered = tiers.with_tier(tiers.user_activity(first_log), tiers.TierBounds.fixed())
    return tiers.tier_amount_stats(first_log, tiered).withColumn(
        "repay_amt", F.col("repay_amt").cast("double")
    )


@query
def tier_feature_on_fact(v: LendingViews) -> DataFrame:
    joined = tiers.tier_on_fact(_fact(v), tiers.user_tier_features(_tiered(v)))
    return shown_as_double(joined, "freq", "most_freq", "median_freq", "lower_freq").select(
        "listing_id",
        "freq",
        "most_freq",
        "median_freq",
        "lower_freq",
        "tier_early_mean",
        "tier_early_var",
    )


@query
def new_user_flag(v: LendingViews) -> DataFrame:
    return tiers.new_user_flag(_fact(v), _first_log(v)).select("listing_id", "is_train", "new_user")


# Behaviour log


@query
def behaviour_weekday_share(v: LendingViews) -> DataFrame:
    return behaviour.weekday_share(v.user_behavior_logs())


@query
def behaviour_month_share(v: LendingViews) -> DataFrame:
    return behaviour.month_share(v.user_behavior_logs())


@query
def behaviour_year_describe(v: LendingViews) -> DataFrame:
    return behaviour.describe_years(v.user_behavior_logs())


@query
def behaviour_type_describe(v: LendingViews) -> DataFrame:
    return behaviour.describe_types(v.user_behavior_logs())


@query
def behaviour_describe(v: LendingViews) -> DataFrame:
    return behaviour.describe_all(v.user_behavior_logs())


@query
def behaviour_hour_histogram(v: LendingViews) -> DataFrame:
    return behaviour.hour_histogram(v.user_behavior_logs())


@query
def user_mean_hours(v: LendingViews) -> DataFrame:
    return behaviour.user_mean_hours(v.user_behavior_logs())


@query
def user_mean_hour_histogram(v: LendingViews) -> DataFrame:
    return behaviour.user_mean_hour_histogram(v.user_behavior_logs())


@query
def user_mean_hour_describe(v: LendingViews) -> DataFrame:
    return behaviour.describe_mean_hours(v.user_behavior_logs())


@query
def behaviour_users_per_row(v: LendingViews) -> DataFrame:
    return behaviour.users_per_row(v.user_behavior_logs())


@query
def log_slice(v: LendingViews) -> DataFrame:
    return behaviour.log_slice(v.user_behavior_logs(), 100, 40_100)


# Tags


@query
def tag_frequency(v: LendingViews) -> DataFrame:
    return tags.tag_frequency(tags.latest_tags(v.user_taglist()))


@query
def tag_top150(v: LendingViews) -> DataFrame:
    return tags.top_tags(tags.tag_frequency(tags.latest_tags(v.user_taglist())))


@query
def important_tags(v: LendingViews) -> DataFrame:
    return tags.important_tags(tags.tag_frequency(tags.latest_tags(v.user_taglist())))


@query
def distinct_tags(v: LendingViews) -> DataFrame:
    exploded = tags.exploded_tags(tags.latest_tags(v.user_taglist()))
    return exploded.agg(F.count_distinct("tag").alias("n_tags"), F.count(F.lit(1)).alias("n_occurrences"))


@query
def tag_tokens(v: LendingViews) -> DataFrame:
    tokens = tags.tag_tokens(tags.latest_tags(v.user_taglist()))
    return tokens.select(
        "user_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("text")
    )


@query
def tag_bag_of_words(v: LendingViews) -> DataFrame:
    return tags.bag_of_words(tags.latest_tags(v.user_taglist())).select(
        "user_id", "word", "n", "n_documents"
    )


@query
def tag_tfidf(v: LendingViews) -> DataFrame:
    return tags.tf_idf(tags.latest_tags(v.user_taglist()))


@query
def tag_feature_vectors(v: LendingViews) -> DataFrame:
    """Dense user statistics next to the sparse tag counts, as coordinates."""
    stats = listings.user_loan_stats(v.listing_info())
    return tags.feature_coordinates(
        stats, ["mean_principal", "std_principal"], tags.latest_tags(v.user_taglist())
    )


def _sparse_input(v: LendingViews) -> sparse_input.SparseInput:
    stats = listings.user_loan_stats(v.listing_info())
    places = users.latest_profiles(v.user_info())
    return sparse_input.sparse_input(
        stats, ["mean_principal", "std_principal"], places, ["cell_province", "id_province", "id_city"], tags.latest_tags(v.user_taglist())
    )


@query
def sparse_matrix(v: LendingViews) -> DataFrame:
    """Numbers, indicators and words in one matrix, read back from the vectors that a model gets."""
    return sparse_input.entries(sparse_input.vectors(_sparse_input(v)), "user_id", "features")


@query
def sparse_matrix_columns(v: LendingViews) -> DataFrame:
    return _sparse_input(v).columns


@query
def sparse_matrix_audit(v: LendingViews) -> DataFrame:
    return sparse_input.audit(sparse_input.vectors(_sparse_input(v)), "user_id", "features")


# Encodings and folds


@query
def category_codes(v: LendingViews) -> DataFrame:
    places = users.latest_profiles(v.user_info()).select(
        "user_id", "cell_province", "id_province", "id_city"
    )
    order = F.col("user_id")
    return encoding.with_codes(places, ["cell_province", "id_province", "id_city"], order, "user_id")


@query
def category_one_hot(v: LendingViews) -> DataFrame:
    places = users.latest_profiles(v.user_info()).select(
        "user_id", "cell_province", "id_province", "id_city"
    )
    return encoding.indicator_rows(places, "user_id", ["cell_province", "id_province", "id_city"])


@query
def stratified_folds(v: LendingViews) -> DataFrame:
    return _folded(v).select("listing_id", "label", "fold")


@query
def fold_label_balance(v: LendingViews) -> DataFrame:
    return _folded(v).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


# Feature table, model, forecast


@query
def feature_table(v: LendingViews) -> DataFrame:
    return shown_as_double(features.feature_table(_tables(v)), *NULLABLE_FEATURES)


@query
def integration_table(v: LendingViews) -> DataFrame:
    return shown_as_double(integration.integration_table(_tables(v)), "label")


@query
def integration_indicators(v: LendingViews) -> DataFrame:
    return integration.integration_indicators(_tables(v))


def _cross_validation(v: LendingViews) -> CrossValidation:
    return CrossValidation.stored(_tables(v))


@query
def model_oof_probabilities(v: LendingViews) -> DataFrame:
    return forecast.probability_columns(_cross_validation(v).out_of_fold())


@query
def model_test_probabilities(v: LendingViews) -> DataFrame:
    return forecast.probability_columns(_cross_validation(v).test_probabilities())


@query
def model_metrics(v: LendingViews) -> DataFrame:
    return metrics.prediction_metrics(_cross_validation(v).out_of_fold())


@query
def model_audit(v: LendingViews) -> DataFrame:
    """Every training listing is scored once, by 33 probabilities that add up to 1."""
    return audit(_cross_validation(v).out_of_fold())


def _fixed_scores(v: LendingViews) -> DataFrame:
    return _folded(v).withColumn("probabilities", fixed_probabilities(F.col("listing_id")))


@query
def prediction_metrics(v: LendingViews) -> DataFrame:
    return metrics.prediction_metrics(_fixed_scores(v))


@query
def expected_amounts(v: LendingViews) -> DataFrame:
    return metrics.expected_amount(_fixed_scores(v)).select(
        "listing_id", "label", "label_probability", "expected_amt"
    )


@query
def probability_table(v: LendingViews) -> DataFrame:
    scored = v.test().select("listing_id", fixed_probabilities(F.col("listing_id")).alias("probabilities"))
    return forecast.probability_columns(scored)


@query
def test_due_date(v: LendingViews) -> DataFrame:
    return forecast.with_forecast_due_date(v.test()).select("listing_id", "auditing_date", "due_date")


@query
def submission_calendar(v: LendingViews) -> DataFrame:
    return forecast.submission_calendar(v.test())


@query
def daily_forecast(v: LendingViews) -> DataFrame:
    scored = v.test().withColumn("probabilities", fixed_probabilities(F.col("listing_id")))
    return forecast.daily_forecast(v.submission(), scored)
