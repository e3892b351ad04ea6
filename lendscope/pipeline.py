"""The whole run over a folder of lending tables: features, cross-validation, forecast file."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lendscope.plans.boosting import BoostSettings
from lendscope.plans.feature_table import LendingTables
from lendscope.plans.forecast import daily_forecast
from lendscope.plans.metrics import prediction_metrics
from lendscope.plans.model import CrossValidation, ForestSettings, Settings
from lendscope.session import build_session
from lendscope.sources.files import read_table, write_csv

SUBMISSION_COLUMNS = ("listing_id", "repay_date", "repay_amt")


def read_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> LendingTables:
    names = ("train", "test", "listing_info", "user_info", "user_taglist", "user_repay_logs")
    return LendingTables(**{name: read_table(spark, folder, name, fmt) for name in names})


def cross_validate(tables: LendingTables, settings: Settings | None = None) -> CrossValidation:
    return CrossValidation.run(tables, settings)


def forecast(
    tables: LendingTables, submission: DataFrame, validation: CrossValidation
) -> DataFrame:
    """Daily amounts for the submission grid from the fold-averaged probabilities."""
    scored = validation.test_probabilities().join(
        tables.test.select("listing_id", "auditing_date"), "listing_id", "left"
    )
    return daily_forecast(submission, scored)


def run(spark: SparkSession, folder: str, out: str, fmt: str = "csv", trees: int = 20, depth: int = 6, boosted: int | None = None) -> None:
    """Print the cross-validated scores and write the forecast to ``out``."""
    tables = read_tables(spark, folder, fmt)
    settings = BoostSettings(boosted, depth) if boosted else ForestSettings(trees, depth)
    validation = cross_validate(tables, settings)
    prediction_metrics(validation.out_of_fold()).orderBy("fold").show()
    grid = read_table(spark, folder, "submission", fmt)
    write_csv(forecast(tables, grid, validation), out, SUBMISSION_COLUMNS)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", help="folder with the lending tables")
    parser.add_argument("out", help="folder for the forecast CSV")
    parser.add_argument("--format", default="csv", choices=("csv", "parquet"))
    parser.add_argument("--trees", type=int, default=20)
    parser.add_argument("--depth", type=int, default=6)
    parser.add_argument("--boosted", type=int, metavar="ROUNDS", help="boosted trees of at most so many rounds instead of a forest")
    args = parser.parse_args()
    run(build_session("lendscope"), args.folder, args.out, args.format, args.trees, args.depth, args.boosted)


if __name__ == "__main__":
    main()
