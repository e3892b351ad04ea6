"""Line deduplication by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines ends a chunk where it is divisible by
``divisor``, so the boundaries depend on content alone and survive inserted or deleted lines
elsewhere. Chunks of two lines or more whose bytes occur more than once in the corpus stay at
their first place (smallest id, then fingerprint, then chunk number) and go everywhere else.

Passages that hold no whole chunk are found by ``passages=True``: lines of which every pair of neighbours
has an earlier place go as well, where such a run has more than ``PASSAGE_WORDS`` words. Each line that goes
is kept at an earlier place, though its neighbours there may differ.

Defined cases: a null text counts as empty, which is one empty line; ids may be null (they sort
last) and rows with the same id and text count as one document, each keeping what it keeps. Only
the id and text columns are read, and those in ``keep``, whose names must differ from the results'. An
empty table gives no rows; a text of any length is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import KEY, keyed, small_side, stored

DIVISOR = 3
PASSAGE_WORDS = 50


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def with_chunks(docs: DataFrame, divisor: int) -> DataFrame:
    """Adds ``_lines`` and ``_chunks``, an array of (no, first, last) over line positions from 0."""
    hashed = docs.withColumn("_lines", F.split("_text", "\n")).withColumn("_hashes", F.transform("_lines", line_hash))
    rolling = lambda i: 31 * F.get("_hashes", i - 1) + F.get("_hashes", i)
    ended = hashed.withColumn(
        "_ends",
        F.filter(
            F.sequence(F.lit(0), F.size("_lines") - 1),
            lambda i: (i == F.size("_lines") - 1) | ((i > 0) & (rolling(i) % divisor == 0)),
        ),
    )
    return ended.withColumn(
        "_chunks",
        F.transform(
            "_ends",
            lambda end, no: F.struct(
                no.alias("no"),
                F.when(no == 0, 0).otherwise(F.get("_ends", no - 1) + 1).alias("first"),
                end.alias("last"),
            ),
        ),
    ).drop("_hashes", "_ends")


def lines_between(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("_lines", first + 1, last - first + 1), "\n")


def repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text", divisor=DIVISOR) -> DataFrame:
    """The chunks to remove: ``_id``, ``_fp`` (hash of the text), ``no``."""
    several = F.transform(
        F.filter("_chunks", lambda c: c["last"] > c["first"]),
        lambda c: F.struct(c["no"].alias("no"), lines_between(c["first"], c["last"]).alias("chunk")),
    )
    # explode_outer: for explode, Catalyst would add a filter that evaluates the array apart.
    chunks = (
        with_chunks(keyed(docs, id_col, text_col), divisor)
        .select(*KEY, F.explode_outer(several).alias("_c"))
        .where("_c.no is not null")
        .select(*KEY, "_c.no", "_c.chunk", F.xxhash64("_c.chunk").alias("digest"))
    )
    return later_places(chunks).select(*KEY, "no")


def later_places(chunks: DataFrame) -> DataFrame:
    """The rows of ``chunks`` whose ``chunk`` has an earlier place."""
    twice = stored(chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    found = stored(chunks.join(small_side(twice, twice.count()), "digest", "left_semi"))
    # Grouping and joining by the chunk itself compares the bytes, whatever the digests say.
    place = lambda p: F.struct(F.col("_id").isNull().alias("none"), *[F.col(c) for c in (*KEY, "no")]).alias(p)
    # Stored apart, so that Spark can split the join where one chunk has very many places.
    first = stored(
        found.groupBy("digest", "chunk").agg(F.min(place("p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return (
        found.withColumn("place", place("place"))
        .join(first, ["digest", "chunk"])
        .where(~F.col("place").eqNullSafe(F.col("first")))
        .select(*KEY, "no", "chunk")
    )


def repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Runs of lines of which each pair of neighbours has an earlier place: ``_id``, ``_fp``, ``first``, ``last``."""
    pairs = F.transform(
        F.slice("_lines", 1, F.size("_lines") - 1),
        lambda line, i: F.struct(i.alias("no"), F.concat_ws("\n", line, F.get("_lines", i + 1)).alias("chunk")),
    )
    rows = (
        keyed(docs, id_col, text_col)
        .withColumn("_lines", F.split("_text", "\n"))
        .select(*KEY, F.explode_outer(pairs).alias("_c"))
        .where("_c.no is not null")
        .select(*KEY, "_c.no", "_c.chunk", F.xxhash64("_c.chunk").alias("digest"))
    )
    words = lambda k: F.size(F.filter(F.split(F.get(F.split("chunk", "\n"), F.lit(k)), r"\s+"), lambda w: w != ""))
    later = later_places(rows).select(*KEY, "no", words(0).alias("here"), words(1).alias("after")).distinct()
    run = F.col("no") - F.row_number().over(Window.partitionBy(*KEY).orderBy("no"))
    return (
        later.withColumn("run", run)
        .groupBy(*KEY, "run")
        .agg(F.min("no").alias("first"), (F.max("no") + 1).alias("last"), (F.sum("here") + F.max_by("after", "no")).alias("words"))
        .where(F.col("words") > PASSAGE_WORDS)
        .select(*KEY, "first", "last")
    )


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", divisor=DIVISOR, keep=(), passages=False) -> DataFrame:
    """Per row ``doc_id``, ``n_lines``, ``n_chunks``, ``n_removed`` (lines) and the kept ``text``, then ``keep``."""
    found = repeated_chunks(docs, id_col, text_col, divisor)
    cuts = [F.collect_set("no").alias("_gone")]
    if passages:
        runs = repeated_passages(docs, id_col, text_col).select(*KEY, F.struct("first", "last").alias("run"))
        found = found.unionByName(runs, allowMissingColumns=True)
        cuts.append(F.collect_list("run").alias("_runs"))
    gone = stored(
        found.groupBy(*KEY)
        .agg(*cuts)
        .withColumnsRenamed({"_id": "_gone_id", "_fp": "_gone_fp"})
    )
    rows = keyed(docs, id_col, text_col, *[F.col(c).alias(f"_keep_{c}") for c in keep])
    joined = rows.join(
        small_side(gone, 5 * gone.count()),
        rows._id.eqNullSafe(gone._gone_id) & (rows._fp == gone._gone_fp),
        "left",
    ).drop("_gone_id", "_gone_fp")
    marked = with_chunks(joined, divisor)
    out = lambda c: F.coalesce(F.array_contains("_gone", c["no"]), F.lit(False))
    kept = F.array_join(
        F.transform(F.filter("_chunks", lambda c: ~out(c)), lambda c: lines_between(c["first"], c["last"])), "\n"
    )
    removed = F.aggregate("_chunks", F.lit(0), lambda n, c: n + F.when(out(c), c["last"] - c["first"] + 1).otherwise(0))
    if passages:
        ranges = F.concat(
            "_runs", F.transform(F.filter("_chunks", out), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last")))
        )
        left = F.filter("_lines", lambda line, i: ~F.exists("_ranges", lambda r: (r["first"] <= i) & (i <= r["last"])))
        marked = marked.withColumn("_ranges", ranges).withColumn("_left", left)
        kept, removed = F.array_join("_left", "\n"), F.size("_lines") - F.size("_left")
    results = F.struct(
        F.size("_lines").alias("n_lines"),
        F.size("_chunks").alias("n_chunks"),
        F.when(F.col("_gone").isNull(), 0).otherwise(removed).alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )
    # An outer explode of one row: a later filter on plain columns would take a copy of the expressions
    # below the projections, where the lines are split and hashed again for every line.
    held = marked.select(
        F.col("_id").alias("doc_id"), *[f"_keep_{c}" for c in keep], F.explode_outer(F.array(results)).alias("_result")
    )
    return held.select(
        "doc_id",
        *[f"_result.{c}" for c in ("n_lines", "n_chunks", "n_removed", "text")],
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
