"""The lending tables derived from the star-schema test tables.

Only integer arithmetic, date addition and string building is used, so the
same definitions give the same rows in any SQL engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.calendar import fixed_month_days, forecast_due_date
from lendscope.functions.classes import UNPAID_DATE

SPLIT_DATE = "2000-01-01"


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


# Columns the views read, declared so that opening a table needs no pass over its footers.
STAR_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_returnflag string",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}


# What each view of the feature build reads.
READS = {
    "train": ("orders",),
    "test": ("orders",),
    "listing_info": ("orders",),
    "user_info": ("customer",),
    "user_taglist": ("lineitem", "orders", "part"),
    "user_repay_logs": ("lineitem", "orders"),
}


@dataclass(frozen=True)
class LendingViews:
    """Each method returns one lending table as a lazy DataFrame."""

    spark: SparkSession
    folder: str

    def _scan(self, name: str) -> DataFrame:
        return self.spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def stored(self) -> dict[str, tuple[DataFrame, ...]]:
        """Per view in ``READS`` the stored tables it is computed from, each table as one frame."""
        scans = {name: self._scan(name) for name in sorted({table for tables in READS.values() for table in tables})}
        return {view: tuple(scans[table] for table in tables) for view, tables in READS.items()}

    def listing_info(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self._scan("orders").select(
            F.col("o_custkey").alias("user_id"),
            key.alias("listing_id"),
            F.col("o_orderdate").cast("date").alias("auditing_date"),
            (3 * (key % 4 + 1)).cast("int").alias("term"),
            ((70 + 5 * (key % 6)) / 10).alias("rate"),
            (500 + 50 * (37 * key % 120)).cast("int").alias("principal"),
        )

    def _loans(self) -> DataFrame:
        days = fixed_month_days(F.col("auditing_date"))
        return self.listing_info().select(
            "user_id",
            "listing_id",
            "auditing_date",
            F.date_add("auditing_date", days).alias("due_date"),
            (F.col("principal") / F.col("term")).alias("due_amt"),
        )

    def train(self) -> DataFrame:
        k = (7 * F.col("listing_id") + F.col("user_id")) % 36
        overdue = k >= 33
        early = F.least(k.cast("int"), fixed_month_days(F.col("auditing_date")))
        return self._loans().filter(F.col("auditing_date") < _date(SPLIT_DATE)).select(
            "*",
            F.when(overdue, F.lit("\\N"))
            .otherwise(F.date_sub("due_date", early).cast("string"))
            .alias("repay_date"),
            F.when(overdue, F.lit("\\N")).otherwise(F.col("due_amt").cast("string")).alias("repay_amt"),
        )

    def test(self) -> DataFrame:
        return self._loans().filter(F.col("auditing_date") >= _date(SPLIT_DATE))

    def submission(self) -> DataFrame:
        """One row per test listing and day up to its due date."""
        due = forecast_due_date(F.col("auditing_date"))
        return self.test().select(
            "listing_id", F.explode(F.sequence("auditing_date", due)).alias("repay_date")
        )

    def user_repay_logs(self) -> DataFrame:
        line = F.col("l_linenumber")
        k = ((7 * F.col("l_partkey") + 3 * F.col("l_suppkey") + line) % 40).cast("int")
        unpaid = k >= 36
        due = F.date_add(F.col("o_orderdate").cast("date"), 30 * line)
        return (
            self._scan("lineitem")
            .join(self._scan("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("user_id"),
                F.col("l_orderkey").alias("listing_id"),
                line.alias("order_id"),
                due.alias("due_date"),
                F.col("l_extendedprice").alias("due_amt"),
                F.when(unpaid, _date(UNPAID_DATE))
                .when(k >= 31, F.date_add(due, k - 30))
                .otherwise(F.date_sub(due, k))
                .alias("repay_date"),
                F.when(~unpaid, 10000.0 * F.floor(F.col("l_extendedprice") / 10000)).alias("repay_amt"),
            )
        )

    def user_info(self) -> DataFrame:
        key = F.col("c_custkey")
        first_insert = F.date_add(_date("2018-01-01"), (key % 300).cast("int"))
        base = self._scan("customer").select(
            key.alias("user_id"),
            F.date_add(_date("2016-01-01"), (31 * (key % 24)).cast("int")).alias("reg_mon"),
            F.when(key % 3 == 0, F.lit(" 男")).otherwise(F.lit("女")).alias("gender"),
            F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("cell_province"),
            F.concat(F.lit("p"), key % 5).alias("id_province"),
            F.when(key % 10 == 0, F.lit("\\N"))
            .otherwise(F.concat(F.lit("c"), 1 + key * key % 37))
            .alias("id_city"),
            first_insert.alias("insertdate"),
        )
        newer = base.filter(F.col("user_id") % 20 == 0).select(
            "user_id",
            "reg_mon",
            F.lit("女").alias("gender"),
            F.lit("p0").alias("cell_province"),
            F.lit("p0").alias("id_province"),
            F.lit("c1").alias("id_city"),
            F.date_add("insertdate", 30).alias("insertdate"),
        )
        return base.unionByName(newer)

    def user_taglist(self) -> DataFrame:
        returned = F.col("l_returnflag") == "R"
        tags = F.when(
            returned,
            F.array("p_type", "p_brand", F.concat(F.lit("size"), "p_size")),
        ).otherwise(F.array("p_type"))
        user_tags = (
            self._scan("lineitem")
            .join(self._scan("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self._scan("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_custkey").alias("user_id"), F.explode(tags).alias("tag"))
            .distinct()
        )
        # Distinct first, so that a user's list is bounded by the tag vocabulary.
        return user_tags.groupBy("user_id").agg(
            F.array_join(F.sort_array(F.collect_list("tag")), "|").alias("taglist"),
            F.date_add(_date("2018-01-01"), (F.col("user_id") % 300).cast("int")).alias("insertdate"),
        )

    def user_behavior_logs(self) -> DataFrame:
        kind = F.col("event_type")
        return self._scan("events").select(
            "user_id",
            F.col("ts").alias("behavior_time"),
            F.when(kind.isin("click", "signup"), 1)
            .when(kind == "view", 2)
            .when(kind.isin("purchase", "error"), 3)
            .alias("behavior_type"),
        )


def fixed_probabilities(listing_id: Column) -> Column:
    """A deterministic probability for each of 33 classes, for use without a model.

    Class i weighs 1 + (i + 3)·listing modulo 17. Those 33 multiples run twice
    through all residues but for one, which gives the total in closed form.
    """
    total = F.when(listing_id % 17 == 0, 33.0).otherwise(305.0 - 2 * listing_id % 17)
    classes = F.sequence(F.lit(0), F.lit(32))
    return F.transform(classes, lambda i: (1 + listing_id * (i + 3) % 17).cast("double") / total)
