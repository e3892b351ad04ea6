"""The whole run from CSV tables to the forecast file."""

from pyspark.sql import functions as F

from lendscope import pipeline
from lendscope.sources.files import write_csv
from lendscope.sources.schemas import SCHEMAS


def test_csv_tables_to_forecast_file(spark, views, tmp_path, capfd):
    for name in SCHEMAS:
        if name not in ("submission", "user_behavior_logs"):
            write_csv(getattr(views, name)(), str(tmp_path / f"{name}.csv"), SCHEMAS[name].names)
    grid = views.submission().withColumn("repay_amt", F.lit(None).cast("double"))
    write_csv(grid, str(tmp_path / "submission.csv"), SCHEMAS["submission"].names)
    out = str(tmp_path / "forecast")
    pipeline.run(spark, str(tmp_path), out, trees=2, depth=2)
    assert "logloss" in capfd.readouterr().out
    written = spark.read.option("header", True).schema(SCHEMAS["submission"]).csv(out)
    assert written.count() == views.submission().count()
    assert written.filter(F.col("repay_amt").isNull()).count() == 0
    # Probabilities of one listing sum to at most one, so its forecast stays within the due amount.
    total = written.groupBy("listing_id").agg(F.sum("repay_amt").alias("total"))
    over = total.join(views.test(), "listing_id").filter(F.col("total") > F.col("due_amt") + 1e-6)
    assert over.count() == 0
