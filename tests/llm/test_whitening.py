"""Whitening against a plain eigendecomposition."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import whitening
from lendscope.llm.queries import QUERIES


def compare(rows, vectors, components=16):
    """``rows`` of the operator against numpy on (id, vector) pairs of one length."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, int((value > 1e-12 * np.trace(v)).sum()))
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(x)
    signs = np.zeros(k)
    for i, v_i in x.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        want = np.array([(n * c - s) / n for c, s in zip(v_i, sums)]) @ vector[:, :k] / np.sqrt(value[:k])
        for c in range(k):
            r = got[i][c + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v_i, sums))
            assert r.explained == pytest.approx(value[c] / value.sum(), rel=1e-10)
            assert r.identity_error < 1e-9 and abs(r.whitened) == pytest.approx(abs(want[c]), rel=1e-6, abs=1e-7)
            if abs(want[c]) > 1e-3:
                sign = np.sign(r.whitened * want[c])
                assert signs[c] in (0, sign)
                signs[c] = sign


def test_query_equals_plain_version(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    compare(QUERIES["op12_feast_whitening"](spark, small_dir).collect(), [(r.vec_id, r.embedding) for r in table])


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_inertia_and_contours(d):
    draw = np.random.default_rng(d)
    q = np.linalg.qr(draw.normal(size=(d, d)))[0]
    spectrum = np.sort(np.concatenate([np.full(d // 3, 5.0), draw.exponential(10, d - d // 3)]))
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    for s in (0.5, 4.9, 5.1, 30):
        assert whitening.negative_count(v - s * np.eye(d)) == (spectrum < s).sum()
    wanted = min(d, 16)
    found = [whitening.feast(v, *part) for part in whitening.intervals(v, wanted)]
    value = np.sort(np.concatenate([f[0] for f in found]))[::-1][:wanted]
    assert np.allclose(value, spectrum[::-1][:wanted], rtol=1e-12)
    vectors = np.concatenate([f[1] for f in found], axis=1)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-2.0, 0.01]), (3, [0.0, 0.0]), (None, [3.0, 1.0])]
    bad = [(4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1e300, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("y"), "component": F.lit(0)})
    rows = whitening.whiten(df).collect()
    assert len(rows) == 10
    compare(rows, good)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0**40 * (i % 5), float(i), -(2.0**33) * i]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values())]
    for r in got:
        want = sum((40 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.n == 40 and r.deviation == (want if want < 1 << 63 else None)
