"""Helpers shared by the operators: scratch tables, row keys and connected components."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many narrow rows may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch sent to Python.
BATCH_BYTES = "8m"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent (tests in one JVM), a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lendscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._lendscope_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` once everything read from them is itself stored."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lendscope_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return this process's freed memory to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """``run``, after which a task's freed memory is given back.

    Spark keeps idle workers for further tasks, and what they hold counts beside the heap of the stages that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow``, with this package shipped to the executors first.

    Batches are kept small: a Python worker holds several copies of one, beside the executor's heap.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_lendscope_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = f"lendscope_{uuid.uuid4().hex[:8]}"
        sc.addPyFile(
            shutil.make_archive(
                os.path.join(tempfile.mkdtemp(), name), "zip", os.path.dirname(package), os.path.basename(package)
            )
        )
        sc._lendscope_shipped = True
    return df.mapInArrow(released(run), schema)


def text_runs(batches: Iterator[pa.RecordBatch], column: str, size: int = 1_000_000) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches as lists by column, in runs of about ``size`` bytes of ``column``.

    Only one run at a time exists as Python objects.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


#: Counters travel in compressed slices of so many.
SLICE = 1 << 12


def sum_counters(df: DataFrame, tally: Callable, size: int) -> np.ndarray:
    """``size`` counters summed over all tasks; ``tally(batches, counters)`` adds one task's counts.

    Tasks send their counters in slices, which other tasks sum, so the driver gets ``size`` numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(-(-size // SLICE) * SLICE, np.int64)
        tally(batches, total[:size])
        rows = [zstandard.compress(b.tobytes()) for b in total.reshape(-1, SLICE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows, pa.binary())], names=["slice", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, block in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
                block = np.frombuffer(zstandard.decompress(block), np.int64)
                total[at] = total[at] + block if at in total else block
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zstandard.compress(b.tobytes()) for b in total.values()], pa.binary())],
            names=["slice", "counts"],
        )

    import zstandard

    ddl = "slice int, counts binary"
    out = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for r in arrow_map(arrow_map(df, count, ddl).repartition("slice"), add, ddl).collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
    return out[:size]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(word: Column) -> Column:
    """A-Z alone in lower case; ``lower`` would change other letters of words beyond ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The parts between matches of ``separators``, several times faster than matching the words."""
    return F.array_remove(F.split(text, separators), "")


#: A row's key: ids may be null or repeat, then the text's hash tells rows apart.
KEY = ["_id", "_fp"]


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``_id``, ``_fp`` and ``_text`` (null as empty) of each row, then ``more``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_fp"), text.alias("_text"), *more)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when ``rows``, the counted size of ``df``, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (columns ``a``, ``b``): ``id``, ``label``.

    Each round points every node at its smallest neighbour, contracts the edges along the
    pointers and drops loops; nodes that are no local minimum vanish, so the number of rounds
    grows with the logarithm of the graph. Labels stay distributed throughout.
    """
    live = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct()
    )
    labels = stored(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while live.take(1):
        pointer = stored(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        # A node that is smallest among its neighbours keeps itself and so has no pointer.
        at = pointer.select(F.col("node").alias("label"), F.col("to"))
        old_labels, old_live = labels, live
        labels = stored(
            labels.join(at, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        )
        to_a, to_b = (pointer.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        moved = live.join(to_a, "a", "left").join(to_b, "b", "left").select(
            F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")
        )
        live = stored(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        )
        discard(pointer, old_labels, old_live)
    return labels
