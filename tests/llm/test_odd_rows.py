"""Nulls, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from lendscope.llm import (
    class_model,
    decontaminate,
    jaccard_join,
    lattice,
    license_scan,
    line_chunks,
    pack,
    rule_classifier,
    run_index,
    secret_ledger,
)
from lendscope.llm.queries import vocabulary_path

COPY = " ".join(f"word{i}" for i in range(40))
LONG = " ".join(f"w{i % 997} the" for i in range(60_000))
ROWS = [
    (1, COPY),
    (1, COPY),
    (2, COPY),
    (3, None),
    (4, ""),
    (5, "   \n\n"),
    (None, COPY),
    (None, None),
    (6, LONG),
    (7, "one"),
    (8, "a\nb\nc\nd\na\nb\nc\nd"),
]
#: Names that the operators use inside.
CLASHING = ["_id", "_fp", "_text", "node", "label", "hash", "n", "words", "score", "rid", "text2", "lines"]
DDL = "doc_id long, text string"


def table(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def items(spark):
    return spark.createDataFrame([(1, COPY), (None, COPY), (2, None), (3, "too short")], "item_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")


RUNS = {
    "secrets": lambda s, d, r: secret_ledger.report(secret_ledger.scan(d)[0]),
    "licenses": lambda s, d, r: license_scan.scan(d),
    "near": lambda s, d, r: jaccard_join.near_duplicates(d),
    "classes": lambda s, d, r: class_model.score(d),
    "lines": lambda s, d, r: line_chunks.dedup_lines(d),
    "leaks": lambda s, d, r: decontaminate.decontaminate(d, items(s)),
    "runs": lambda s, d, r: run_index.dedup(d),
    "packing": lambda s, d, r: pack.pack(d, vocabulary_path()),
    "quality": lambda s, d, r: rule_classifier.score(d, rule_classifier.fit(d, labels(s, r))),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    got = RUNS[name](spark, table(spark, ROWS), ROWS).toPandas()
    if name == "packing":
        assert got.doc_id.nunique(dropna=False) == 9
        return
    assert len(got) == len(ROWS)
    assert sorted(got.doc_id.fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    if name == "near":
        assert by.component_id[2] == 1 and by.component_id[3] == 3 and by.n_shingles[1] == 36
        assert by.n_shingles[4] == 0 and by.n_shingles[7] == 1
        assert set(got[got.doc_id.isna()].component_id.fillna(-1)) == {1, -1}
    if name == "leaks":
        assert by.n_leaks[1] == 1 and by.n_leaks[2] == 1 and by.n_leaks[6] == 0
    if name == "runs":
        assert by.n_removed[1] == 0 and by.n_removed[2] == len(COPY) and by.n_bytes[3] == 0
    if name == "secrets":
        assert (got.spans == "").all()
    if name == "licenses":
        assert by.n_words[1] == 40 and by.n_words[3] == 0 and by.labels[6] == ""


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    assert RUNS[name](spark, table(spark, []), []).count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("cell", F.lit(2))
    got = {(r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect()}
    alone = {(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert got == {(1, 3, 1), (2, 3, 1), (None, 3, 1)} | alone
    assert lattice.near_duplicates(df.where("false")).count() == 0
