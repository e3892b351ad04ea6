"""Near-duplicate embeddings by lattice hashing.

Every table projects the normalised vectors with its own random matrix and decodes each group of eight
coordinates to the nearest point of the E8 lattice; the points of all groups together name a cell. A
vector is entered in its own cell and, as a probe, in neighbouring cells: in one group at a time it
takes the nearest point of the other coset of D8, or the next point of the same coset. Pairs that meet
in a cell where one of them is at home are verified by cosine in double precision.

Equal vectors are one node with a count. Cells are counted first, on ids alone; vectors join only the
cells in which something meets, and a crowded cell is split into blocks of bounded size whose pairs
of blocks are separate groups. Nothing is capped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, as do vectors of different lengths; null ids count as links of others and are never a
component's name unless all its ids are null. Rows that repeat an id and vector are separate vectors.
Further columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lendscope.llm.common import arrow_map, components, stored

COSINE = 0.95
TABLES, GROUPS, SCALE, SEED = 6, 2, 0.28, 11
#: Entries of a block of a crowded cell, on average.
BLOCK = 1000


def d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and next points of D8: integer vectors with an even sum."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)
    row = np.arange(len(x))
    step = np.where(off >= 0, 1.0, -1.0)
    odd = near.sum(1) % 2 != 0
    best, following = near.copy(), near.copy()
    one, two = order[:, 0], order[:, 1]
    best[row[odd], one[odd]] += step[row[odd], one[odd]]
    # From an odd rounding the next point moves the second coordinate instead, from an even one both.
    following[row, two] += step[row, two]
    even = ~odd
    following[row[even], one[even]] += step[row[even], one[even]]
    return best, following


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice the nearest point of E8, the nearest of the other coset, and the next of the same coset."""
    whole, whole_next = d8(x)
    half, half_next = d8(x - 0.5)
    half, half_next = half + 0.5, half_next + 0.5
    first = (((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None]
    pick = lambda a, b: (2 * np.where(first, a, b)).astype(np.int16)
    return pick(whole, half), pick(half, whole), pick(whole_next, half_next)


def projection(table: int, groups: int, dim: int) -> np.ndarray:
    draw = np.random.default_rng([SEED, table]).normal(size=(dim, 8 * groups))
    return draw / np.sqrt(dim)


def cells(x: np.ndarray, table: int, groups: int = GROUPS, scale: float = SCALE) -> np.ndarray:
    """Cell hashes of unit vectors, one row each: the home cell, then the probes."""
    y = x @ projection(table, groups, x.shape[1]) / scale
    parts = [e8(y[:, 8 * g : 8 * g + 8]) for g in range(groups)]
    home = np.concatenate([p[0] for p in parts], axis=1)
    found = [home]
    for g, p in enumerate(parts):
        for other in p[1:]:
            cell = home.copy()
            cell[:, 8 * g : 8 * g + 8] = other
            found.append(cell)
    return np.stack([[xxh3_64_intdigest(c.tobytes(), table) for c in f] for f in found], axis=1).astype(np.uint64)


ENTRY = "table int, cell long, node long, home boolean"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def entries(nodes: DataFrame, dim: int, tables: int, groups: int, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part["vector"], dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids = part["node"].to_numpy(zero_copy_only=False)
                for table in range(tables):
                    found = cells(x, table, groups, scale)
                    k = found.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(found.size, table, np.int32)),
                            pa.array(found.reshape(-1).view(np.int64)),
                            pa.array(np.repeat(ids, k)),
                            pa.array(np.tile(np.arange(k) == 0, len(ids))),
                        ],
                        names=["table", "cell", "node", "home"],
                    )

    return arrow_map(nodes.select("node", "vector"), run, ENTRY)


def links(nodes: DataFrame, dim: int, cosine=COSINE, tables=TABLES, groups=GROUPS, scale=SCALE) -> DataFrame:
    """Verified pairs of nodes, ``a`` < ``b``, each once."""
    placed = stored(entries(nodes, dim, tables, groups, scale))
    crowd = placed.groupBy("table", "cell").agg(F.count("*").alias("size"), F.max("home").alias("met"))
    crowd = crowd.where("size > 1 and met").select("table", "cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    here = placed.join(crowd, ["table", "cell"]).join(nodes.select("node", "vector"), "node")
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    spread = here.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["table", "cell", "low", "high"]
    dealt = (
        spread.select("table", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "home", "vector")
        .repartition(*key)
        .sortWithinPartitions(*key)
    )

    def compare(x: np.ndarray, ids: np.ndarray, home: np.ndarray, own: np.ndarray, across: bool):
        """Pairs of one group, the left side in runs so that the product stays small."""
        for at in range(0, len(ids), 512):
            left = slice(at, at + 512)
            ok = (x[left] @ x.T >= cosine) & (home[left, None] | home[None, :]) & (ids[left, None] < ids[None, :])
            if across:
                ok &= own[left, None] != own[None, :]
            i, j = np.nonzero(ok)
            yield ids[i + at], ids[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: pa.Table):
            part = held.combine_chunks()
            keys = np.stack([part[k].to_numpy() for k in key], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            x = _matrix(part["vector"].combine_chunks(), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ids, home, own = part["node"].to_numpy(), part["home"].to_numpy(), part["own"].to_numpy()
            found = [(np.empty(0, np.int64),) * 2]
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if b - a > 1:
                    found += compare(x[a:b], ids[a:b], home[a:b], own[a:b], keys[a, 2] != keys[a, 3])
            a, b = (np.concatenate(s) for s in zip(*found))
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            # The last group may go on in the next batch.
            keys = np.stack([held[k].to_numpy() for k in key], axis=1)
            same = (keys == keys[-1]).all(1)
            end = held.num_rows - int(same.sum())
            if end:
                yield from whole(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from whole(held)

    return arrow_map(dealt, run, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", cosine=COSINE, tables=TABLES, groups=GROUPS, scale=SCALE) -> DataFrame:
    """Per vector ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # An aggregate over null elements is null, and so is not true.
    fine = F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0),
        F.lit(False),
    )
    keyed = plain.select("vec_id", "vector", F.when(fine, F.xxhash64("vector")).alias("node"))
    nodes = stored(
        keyed.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    )
    pairs = None
    for (dim,) in nodes.select(F.size("vector")).distinct().collect():  # one length as a rule
        found = links(nodes.where(F.size("vector") == dim), dim, cosine, tables, groups, scale)
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        pairs = vectors.sparkSession.createDataFrame([], "a long, b long")
    pairs = stored(pairs)
    ends = pairs.union(pairs.select("b", "a")).toDF("node", "peer")
    degree = ends.join(nodes.select(F.col("node").alias("peer"), "copies"), "peer").groupBy("node").agg(F.sum("copies").alias("linked"))
    at = components(pairs).withColumnRenamed("id", "node")
    classed = nodes.select("node", "least", "copies").join(at, "node", "left").withColumn("label", F.coalesce("label", "node"))
    name = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = classed.join(name, "label").join(degree, "node", "left").select(
        "node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return (
        keyed.select("vec_id", "node")
        .join(facts, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
