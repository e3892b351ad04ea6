"""CSV and Parquet sources, the CSV sink, and the lending views' known sizes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendscope.functions.labels import with_label
from lendscope.sources.files import read_checked, read_table, write_csv, write_sorted_csv
from lendscope.sources.schemas import SCHEMAS


def test_csv_keeps_missing_text_in_strings_and_nulls_elsewhere(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "user_id,listing_id,auditing_date,due_date,due_amt,repay_date,repay_amt\n"
        "1,10,2018-01-10,2018-02-10,72.5,2018-02-08,72.5\n"
        "2,11,2018-01-10,2018-02-10,\\N,\\N,\\N\n"
    )
    rows = read_table(spark, str(tmp_path), "train").orderBy("listing_id").collect()
    assert rows[0]["due_date"] == dt.date(2018, 2, 10)
    assert (rows[1]["due_amt"], rows[1]["repay_date"], rows[1]["repay_amt"]) == (None, "\\N", "\\N")
    labels = with_label(read_table(spark, str(tmp_path), "train")).orderBy("listing_id")
    assert [r["label"] for r in labels.collect()] == [2, 32]


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_every_table_round_trips(spark, views, tmp_path, name):
    build = getattr(views, name)()
    table = build.select([c for c in build.columns if c in SCHEMAS[name].names])
    columns = [c for c in SCHEMAS[name].names if c in table.columns]
    write_csv(table, str(tmp_path / f"{name}.csv"), columns)
    back = read_table(spark, str(tmp_path), name).select(columns) if columns == SCHEMAS[name].names else None
    table.write.parquet(str(tmp_path / f"{name}.parquet"))
    parquet = read_table(spark, str(tmp_path), name, "parquet").select(columns)
    assert parquet.count() == table.count()
    assert parquet.exceptAll(table.select(columns)).count() == 0
    if back is not None:
        assert dict(back.dtypes) == {f.name: f.dataType.simpleString() for f in SCHEMAS[name]}
        assert back.exceptAll(table.select(columns)).count() == 0


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="orc"):
        read_table(spark, str(tmp_path), "train", "orc")


def test_view_sizes(views_001):
    v = views_001
    listing = v.listing_info().agg(F.count("*"), F.sum("principal"), F.sum("term")).first()
    assert tuple(listing) == (15_000, 52_125_000, 112_500)
    assert v.train().count() == 11_326
    assert v.train().filter(F.col("repay_amt") == "\\N").count() == 997
    assert v.test().count() == 3_674
    assert v.submission().count() == 37_731
    log = v.user_repay_logs()
    unpaid = F.count_if(F.col("repay_date") == F.lit("2200-01-01").cast("date"))
    late = F.count_if((F.col("repay_date") > F.col("due_date")) & F.col("repay_amt").isNotNull())
    first = F.count_if(F.col("order_id") == 1)
    found = log.agg(F.count("*"), unpaid, late, F.count("repay_amt"), first).first()
    assert tuple(found) == (60_000, 6_157, 7_290, 53_843, 8_590)
    info = v.user_info()
    assert info.count() == 1_575
    assert info.filter(F.trim("gender") == "男").count() == 500
    assert info.filter(F.col("id_city") == "\\N").count() == 150
    kinds = {r[0]: r[1] for r in v.user_behavior_logs().groupBy("behavior_type").count().collect()}
    assert kinds == {1: 4023, 2: 1982, 3: 3995}


def test_label_counts(views_001):
    labels = {r[0]: r[1] for r in with_label(views_001.train()).groupBy("label").count().collect()}
    assert sorted(labels) == list(range(33))
    assert (labels[31], labels[32]) == (795, 997)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "user_taglist.csv").write_text("extra,taglist,insertdate,user_id\nx,a|b,2018-01-02,7\n")
    row = read_table(spark, str(tmp_path), "user_taglist").first()
    assert (row["user_id"], row["taglist"], str(row["insertdate"])) == (7, "a|b", "2018-01-02")
    (tmp_path / "user_info.csv").write_text("user_id,gender\n1,x\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_table(spark, str(tmp_path), "user_info")


def test_broken_rows_are_set_apart_and_counted(spark, tmp_path):
    (tmp_path / "listing_info.csv").write_text(
        "listing_id,user_id,auditing_date,term,rate,principal,extra\n"
        "10,1,2018-01-10,3,7.5,500,x\n"
        "11,1,2018-01-32,3,7.5,500,x\n"
        "12,1,2018-01-10,three,much,500,x\n"
        "13,1,2018-01-10\n"
        "14,1,2018-01-10,3,7.5,500,x,y,z\n"
        "15,\\N,2018-01-10,,7.5,500,\n"
    )
    checked = read_checked(spark, str(tmp_path), "listing_info")
    rows = {r.listing_id: r for r in checked.rows.collect()}
    assert sorted(rows) == [10, 15]
    assert rows[10].user_id == 1 and rows[10].auditing_date == dt.date(2018, 1, 10) and rows[10].principal == 500
    assert rows[15].user_id is None and rows[15].term is None
    assert {r.reason: r.n for r in checked.counts().collect()} == {"auditing_date": 1, "term,rate": 1, "fields": 2}
    assert {r.line for r in checked.rejected.collect() if r.reason == "fields"} == {"13,1,2018-01-10", "14,1,2018-01-10,3,7.5,500,x,y,z"}
    assert checked.rows.count() == 2 and checked.rejected.select("reason").count() == 4
    (tmp_path / "train.csv").write_text("user_id,listing_id\n1,2\n")
    with pytest.raises(ValueError, match="auditing_date"):
        read_checked(spark, str(tmp_path), "train")


def test_sorted_csv_goes_on_from_file_to_file(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").alias("b"))
        write_sorted_csv(df, str(tmp_path / "out"), ["a", "b"], ["a"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and [int(x.split(",")[0]) for x in lines] == sorted(i * 7919 % 5003 for i in range(5000))
