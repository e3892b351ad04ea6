"""The named queries of the operators; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendscope.llm import class_model, decontaminate, fingerprints, jaccard_join, lattice, license_scan, line_chunks, nra_search, pack, rule_classifier, run_index, secret_ledger, whitening
from lendscope.llm.common import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    findings, _ = secret_ledger.scan(documents(spark, folder))
    return secret_ledger.report(findings)


def op2_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, folder))


def op4_lattice_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op5_class_model(spark: SparkSession, folder: str) -> DataFrame:
    return class_model.score(documents(spark, folder))


def op6_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.dedup_lines(documents(spark, folder))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op8_run_index(spark: SparkSession, folder: str) -> DataFrame:
    return run_index.dedup(documents(spark, folder))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack(documents(spark, folder), vocabulary_path())


def op10_rule_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return rule_classifier.score(docs, rule_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op11_nra_search(spark: SparkSession, folder: str) -> DataFrame:
    return nra_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_ledger, op2_license_diagonals, op3_jaccard_join, op4_lattice_hashing, op5_class_model, op6_line_chunks, op7_decontamination, op8_run_index, op9_packing, op10_rule_classifier, op11_nra_search, op12_feast_whitening, op13_weighted_sampling)
}
