"""Fingerprints: odd rows, and collision rates against the generalised Jaccard similarity. SQL is in test_sql."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lendscope.llm import fingerprints

DDL = "doc_id long, text string"


def bag(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def run(spark, rows):
    df = spark.createDataFrame(rows, DDL).withColumns({"n": F.lit(1), "place": F.lit("x"), "fp": F.lit(0.5), "word": F.lit("w")})
    return fingerprints.fingerprint(df).collect()


def test_likeness_follows_the_generalised_jaccard_similarity(spark):
    draw = random.Random(5)
    weights = [1 / (k + 1) for k in range(60)]
    # Each pair of documents has words of its own, so that the draws of different pairs are independent.
    rows = [(i, " ".join(draw.choices([f"w{i // 2}x{k}" for k in range(60)], weights, k=draw.choice([20, 80, 300])))) for i in range(600)]
    got = {r.doc_id: r for r in run(spark, rows)}
    off_next, off_edited = [], []
    for i, text in rows[::2]:
        following = rows[(i + 1) % len(rows)][1]
        h = len(text) // 2
        changed = text[: len(text) - h] + following[:h]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        off_next.append(got[i].near_next - jaccard(bag(text), bag(following)))
        off_edited.append(got[i].near_edited - jaccard(bag(text), bag(changed)))
    for off in (off_next, off_edited):
        # 300 means of 32 draws: neither biased nor wider than draws are.
        assert abs(sum(off) / len(off)) < 0.015
        assert sum(x * x for x in off) / len(off) < 1.3 * 0.25 / fingerprints.SAMPLES


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997} the" for i in range(40_000))
    rows = [(4, "alpha Beta beta"), (1, None), (2, ""), (3, " \n"), (None, "last"), (7, "ALPHA beta, BETA"), (7, "other"), (9, long), (9, long), (10, "日本語 テスト 👍 é")]
    got = run(spark, rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 0].fingerprint == by[2, 0].fingerprint == by[3, 2].fingerprint == ""
    assert by[1, 0].near_next == by[2, 0].near_next == 1.0 and by[3, 2].near_next == 0.0
    assert by[4, 15].fingerprint == by[7, 16].fingerprint != by[7, 5].fingerprint
    assert len(by[9, len(long)].fingerprint) == 8 * fingerprints.SAMPLES
    assert sum(r.doc_id == 9 for r in got) == 2
    # The last document is followed by the first, whose text is empty here.
    assert by[None, 4].edited_sha256 == hashlib.sha256(b"la").hexdigest()


def test_few_documents(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(1, "one two")])
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"one one").hexdigest()


def test_no_python_and_texts_shuffled_once(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    plan = fingerprints.fingerprint(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
