"""Ranked search against a brute-force version, on odd rows and with small levels."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendscope.llm import nra_search

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(nra_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """All scores by the formula; the ten best of each item."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * total) // length
            s = 0
            for t in terms(text):
                if bag[t]:
                    s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=repr)


def found(spark, docs, items):
    df = nra_search.search(spark.createDataFrame(docs, DOCS).withColumn("term", F.lit(1)).withColumn("score", F.lit("x")), spark.createDataFrame(items, ITEMS).withColumn("qid", F.lit(1)))
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed):
    """Skewed words, copies, near copies and ties."""
    draw = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"wört{i}É" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 5, 40, 200])))) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + i, rows[4][1] + f" extra{i % 3}") for i in range(20)]
    draw.shuffle(rows)
    items = [(i, " ".join(draw.choices(vocabulary, k=12))) for i in range(8)] + [(8, rows[5][1]), (9, rows[3][1])]
    return rows, items


@pytest.mark.parametrize(("seed", "depth", "growth"), [(1, 1000, 4), (2, 3, 2), (3, 10, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, depth, growth):
    monkeypatch.setattr(nra_search, "DEPTH", depth)
    monkeypatch.setattr(nra_search, "GROWTH", growth)
    docs, items = corpus(seed)
    assert found(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 501} the" for i in range(40_000))
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, "ALPHA beta"), (None, "alpha beta"), (3, None), (4, ""), (5, " \n,"), (6, long), (7, "the")]
    items = [(1, "Alpha, alpha gamma"), (None, "the w7"), (2, None), (3, ""), (4, "absent"), (5, "beta")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "alpha")]) == []
    assert found(spark, [(1, "alpha")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "alpha")]) == []
    assert found(spark, [(1, "beta")], [(1, "alpha")]) == []
