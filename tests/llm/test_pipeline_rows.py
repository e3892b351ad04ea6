"""The pipeline's stages on documents with odd rows and with columns named as the operators' results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

RESULTS = """score held_out predicted n_lines n_chunks n_removed component_id n_shingles n_leaks n_items items reworded
_id _fp _text _kept label node none sequence_id offset""".split()
STAGES = dict(corpus_pipeline.STAGES)


def with_results(docs):
    """Each added column holds a value made of its name and the row's id."""
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in RESULTS])


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    given = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "no id " * 30), (9003, "a\nb " * 4000)], "doc_id long, text string")
    return with_results(given.unionByName(odd, allowMissingColumns=True)).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_other_columns_come_back_unchanged(spark, small_dir, docs, name):
    out = STAGES[name](spark, docs, small_dir)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) > 100
    for r in rows:
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in RESULTS)
    if name != "line dedup":
        assert out.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_packing_takes_any_columns(spark, small_dir, docs):
    pieces = STAGES["packing"](spark, docs, small_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)
    assert pieces.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_stay_empty(spark, small_dir, docs, name):
    out = STAGES[name](spark, docs.where("false"), small_dir)
    assert out.count() == 0
