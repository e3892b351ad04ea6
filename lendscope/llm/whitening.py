"""Whitening of embeddings with eigenvectors found by contour integration (FEAST).

Entries become integers, and the fit list holds each distinct integer vector once. Spark sums the list's
dimensions exactly, then the products of its centred vectors; the driver sees sums by dimension and the
covariance, both bounded by the dimension of the vectors and not by their number.

Inertia counts (signs of an L D L^T factorisation of the shifted covariance) cut the upper spectrum into
intervals of few eigenvalues. Each interval is a Spark row, and its task iterates on a subspace: the contour
integral around the interval, a quadrature of complex shifted solves, filters the subspace, and Rayleigh-Ritz
extracts eigenpairs from it. A task ends only when it has as many converged pairs as the inertia counts say,
so none is missed.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are entries whose
integer exceeds 64 bits; vectors of different lengths are fitted apart; directions without variance
(eigenvalue at most ``FLAT`` of the trace) are no components, so a single or constant vector gets no rows;
fewer dimensions give fewer components; a ``deviation`` beyond 64 bits is null. Repeated rows are returned
each, null ids are kept, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import arrow_map, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues wanted in one interval, nodes of the quadrature, and bounds for residuals and rounds.
CROWD, NODES, RESIDUAL, ROUNDS = 4, 8, 2e-14, 60
FLAT = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def negative_count(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by pivots of one or two rows (Sylvester)."""
    a, count = a.copy(), 0
    while len(a):
        size = np.abs(a)
        off = size - np.diag(np.diag(size))
        one = int(np.argmax(np.diag(size)))
        if size[one, one] == 0 and not off.any():
            return count
        if size[one, one] >= 0.64 * off.max():
            at = [one]
        else:
            at = list(np.unravel_index(int(np.argmax(off)), off.shape))
        rest = np.setdiff1d(np.arange(len(a)), at)
        block, side = a[np.ix_(at, at)], a[np.ix_(rest, at)]
        # A pivot of two rows is taken only where its determinant is negative: one sign of each kind.
        count += 1 if len(at) == 2 else int(block[0, 0] < 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return count


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals with their counts that together hold at least the ``wanted`` greatest eigenvalues."""
    eye, scale = np.eye(len(v)), np.abs(v).sum(1).max()

    def below(s: float) -> int:
        return negative_count(v - s * eye)

    def edge(lo: float, hi: float) -> tuple[float, int] | None:
        """A place to cut with no eigenvalue close to it."""
        for part in (0.5, 0.4, 0.6, 0.3, 0.7):
            s, near = lo + part * (hi - lo), 1e-9 * (hi - lo)
            if (count := below(s - near)) == below(s + near):
                return s, count
        return None

    if not scale:
        return []
    top = scale * (1 + 1e-6)
    low = FLAT * np.trace(v)
    open_ends = [(low, top, below(low), len(v))]
    found: list[tuple[float, float, int]] = []
    while open_ends:
        lo, hi, a, b = open_ends.pop()
        if b == a or len(v) - b >= wanted:
            continue
        cut = edge(lo, hi) if b - a > CROWD and hi - lo > 1e-8 * scale else None
        if cut is None:
            found.append((lo, hi, b - a))
        else:
            open_ends += [(lo, cut[0], a, cut[1]), (cut[0], hi, cut[1], b)]
    return found


def feast(v: np.ndarray, lo: float, hi: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` between ``lo`` and ``hi``."""
    d = len(v)
    scale, centre, radius = np.abs(v).sum(1).max(), (lo + hi) / 2, (hi - lo) / 2
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - node))
    width = min(d, 2 * count + 8)
    y = np.random.default_rng(d).normal(size=(d, width))
    for _ in range(ROUNDS):
        # Conjugate nodes below the axis give the conjugate solution, so the upper half suffices.
        solved = (w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y)).real for w, t in zip(weight, turn))
        basis = np.linalg.qr(sum(solved))[0]
        value, small = np.linalg.eigh(basis.T @ v @ basis)
        y = basis @ small
        good = (value > lo) & (value <= hi) & (np.linalg.norm(v @ y - y * value, axis=0) <= RESIDUAL * scale)
        if good.sum() == count:
            return value[good], y[:, good]
    raise ArithmeticError(f"{int(good.sum())} of {count} eigenvalues converged between {lo} and {hi}")


def eigenpairs(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their vectors as columns; one task per interval."""
    parts = intervals(v, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                value, vector = feast(v, row["lo"], row["hi"], row["n"])
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(vector.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    if not parts:
        return np.empty(0), np.empty((len(v), 0))
    table = spark.createDataFrame([(float(lo), float(hi), int(n)) for lo, hi, n in parts], "lo double, hi double, n int")
    found = arrow_map(table.repartition(len(parts), "lo"), run, "value double, vector array<double>").collect()
    found = sorted(found, key=lambda r: -r["value"])[:wanted]
    return np.array([r["value"] for r in found]), np.array([r["vector"] for r in found]).reshape(-1, len(v)).T


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


class Centre:
    """``n * x - S`` in whole numbers, and the centred vectors as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        # Half of 64 bits leaves room for the difference; beyond it Python's integers.
        reach = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if reach < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        z = self.scaled(x)
        if z.dtype == object or z.shape[1] * int(np.abs(z).max(initial=0)) ** 2 >= 1 << 63:
            z = z.astype(object)
        return [int(s) if s < 1 << 63 else None for s in (z * z).sum(1)]


def sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sum of each dimension; halves of 32 bits keep a task's sums within 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = matrix(batch["x"], dim)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        total = [Decimal((int(h) << 32) + int(v)) for h, v in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.decimal128(28, 0))], names=["i", "s"])

    rows = arrow_map(fit, run, "i int, s decimal(28,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def covariance(fit: DataFrame, dim: int, centre: Centre, weights: np.ndarray | None = None) -> np.ndarray:
    """Mean product of the centred vectors, projected on ``weights`` first if given."""
    k = dim if weights is None else weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                c = centre.centred(matrix(batch.slice(at, 4096)["x"], dim))
                c = c if weights is None else c @ weights
                total += c.T @ c
        i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=["i", "j", "s"])

    out = np.zeros((k, k))
    for r in arrow_map(fit, run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return (out + out.T) / 2 / centre.n


def whiten_length(rows: DataFrame, fit: DataFrame, dim: int, n: int, components: int) -> DataFrame | None:
    """Whitened rows of the vectors of one length."""
    centre = Centre(n, sums(fit, dim))
    v = covariance(fit, dim, centre)
    value, vector = eigenpairs(rows.sparkSession, v, min(components, dim))
    if not len(value):
        return None
    weights = vector / np.sqrt(value)
    error = float(np.abs(covariance(fit, dim, centre, weights) - np.eye(len(value))).max())
    explained = value / np.trace(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, k = matrix(part["x"], dim), len(value)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n, np.int64)),
                        pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array((centre.centred(x) @ weights).reshape(-1)),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return arrow_map(rows, run, RESULT)


def whiten(vectors: DataFrame, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("vector", lambda c: F.try_add(F.floor(SCALE * c).cast("long"), F.lit(SHIFT).cast("long")))
    rows = plain.where(fine).select("vec_id", whole.alias("x")).where(F.forall("x", lambda c: c.isNotNull()) & (F.size("x") > 0))
    fit = stored(rows.select("x").distinct())
    out = None
    for dim, n in fit.groupBy(F.size("x")).count().collect():  # one length as a rule
        of = F.size("x") == dim
        part = whiten_length(rows.where(of), fit.where(of), dim, n, components)
        if part is not None:
            out = part if out is None else out.union(part)
    return vectors.sparkSession.createDataFrame([], RESULT) if out is None else out
