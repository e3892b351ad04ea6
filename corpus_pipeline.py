"""A corpus from raw documents to packed sequences, in stages that each filter or rewrite the documents.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return
the columns of ``documents``. Ids are taken as unique: rows of one id stay or go together.

Defined cases: null texts are judged as empty ones, and line dedup makes them empty; rows
without id are kept unless their text is rejected; further columns, whatever their names, travel in one struct
past the operators and come back unchanged; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import decontaminate, jaccard_join, line_chunks, pack, rule_classifier
from lendscope.llm.common import documents, small_side, stored
from lendscope.llm.queries import vocabulary_path


#: Holds a document's other columns on the way through an operator, so that no name of theirs meets a result's.
KEPT = "_kept"


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """``docs`` with the columns ``apart``, and all other columns as one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*others or [F.lit(None).alias("none")]).alias(KEPT))


def beside_text(docs: DataFrame) -> DataFrame:
    """As ``packed`` with the id apart, and the text once more for the operator, which does not return it."""
    whole = packed(docs, "doc_id")
    return whole.withColumn("text", F.col(KEPT)["text"])


def unpacked(result: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The original columns of a result that carries ``KEPT``."""
    return result.select(*[F.col(c) if c in apart else F.col(KEPT)[c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble rejects."""
    model = rule_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = rule_classifier.score(beside_text(docs), model, keep=[KEPT])
    return unpacked(scored.where("predicted = 1"), docs.columns, "doc_id")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks and passages of lines; documents of which nothing is left go."""
    cut = line_chunks.dedup_lines(packed(docs, "doc_id", "text"), keep=[KEPT], passages=True).where("n_removed = 0 or text <> ''")
    out = unpacked(cut, docs.columns, "doc_id", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    classes = jaccard_join.near_duplicates(docs)
    gone = stored(classes.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(beside_text(docs), items, keep=[KEPT])
    return unpacked(found.where("n_leaks = 0"), docs.columns, "doc_id")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: The classifier is fitted and the tokenizer is no SQL function; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
