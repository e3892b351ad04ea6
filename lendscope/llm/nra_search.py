"""Ranked lexical search by NRA: sorted reads only, with score intervals per document.

Documents of equal text are one class with a count. Their postings are written once, in levels by impact:
level l of a term's list ends at its ``DEPTH * GROWTH ** l`` greatest impacts. A round reads the next level
of every list (earlier levels are read again, which costs a fraction as levels grow geometrically) and keeps
per item and class a lower score, the sum of what was read, and an upper score, which adds each unread
list's greatest unread impact. Once a class that was never read cannot reach an item's tenth lower score, the
item is closed, and from then on only its candidates are followed; candidates whose upper score falls below
the tenth lower score, or ties with it at a greater id, go. An item ends when all its candidates are exact,
so membership, ties and scores are final. The last level leaves nothing unread, so every item ends.

Nothing is looked up by document during the search. The driver holds two sums and the number of levels;
terms, items, bounds and candidates are tables, broadcast only below a counted size.

Defined cases: null texts have no terms, items without terms or without matching documents no rows; each
item row with its own id or text is searched on its own, equal item rows once; documents that repeat an id
are ranked one by one; null ids come last among equal scores; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.llm.common import ascii_lower, scratch_folder, small_side, split_words, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = TERM.replace("^", "")
TOP = 10
#: Postings of a list in the first level, and how much deeper each following one reaches.
DEPTH, GROWTH = 1000, 4
#: Impacts, below 1,000,000, are counted in steps of this width to find the levels.
STEP = 4096
#: A class of equal texts: its least id (null ids count as the greatest) and two hashes of the text.
CLASS = ["least", "h", "g"]
LAST_ID = (1 << 63) - 1
RESULT = "item_id long, rank int, doc_id long, score long"


def words(text: Column) -> Column:
    return split_words(text, SEPARATORS)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per item row (``qid``) its id, terms and their number in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text.alias("text")).distinct()
    qid = F.xxhash64(F.col("item_id").isNull(), F.coalesce("item_id", F.lit(0)), "text")
    exploded = rows.select(qid.alias("qid"), "item_id", F.explode(words(F.col("text"))).alias("word"))
    return exploded.groupBy("qid", "item_id", ascii_lower(F.col("word")).alias("term")).agg(F.count("*").alias("times"))


def class_terms(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per class and query term its ``tf``; a null term counts all other words. ``first`` marks one row of each class.

    Texts are shuffled once, by their hashes; splitting, look-up and counting stay in the same tasks.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    classes = rows.groupBy(F.xxhash64("text").alias("h"), F.hash("text").alias("g")).agg(
        F.coalesce(F.min("id"), F.lit(LAST_ID)).alias("least"), F.count("*").alias("copies"), F.first("text").alias("text")
    )
    split = classes.select(*CLASS, "copies", words(F.col("text")).alias("words"))
    tokens = split.select(*CLASS, "copies", F.size("words").cast("long").alias("n"), F.posexplode("words").alias("pos", "word"))
    found = tokens.select(*CLASS, "copies", "n", "pos", ascii_lower(F.col("word")).alias("word")).join(vocabulary, "word", "left")
    return found.groupBy(*CLASS, "copies", "n", "term").agg(F.count("*").alias("tf"), F.max(F.col("pos") == 0).alias("first"))


def impacts(raw: DataFrame, total: int, length: int, longest: int) -> DataFrame:
    """Impact of every posting; in decimals where 75 * n * N may exceed 64 bits."""
    if 75 * longest * total < 1 << 63:
        share = f"(75 * n * {total}L) div {length}L"
    else:
        share = f"cast((75 * cast(n as decimal(18,0)) * {total}BD) div {length}BD as bigint)"
    hits = raw.where("term is not null").withColumn("m", F.expr(f"25 + {share}"))
    return hits.select(*CLASS, "term", F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)").alias("impact"))


def levels(postings: DataFrame) -> DataFrame:
    """The level of each ``term`` and ``step`` of impacts."""
    counted = postings.groupBy("term", F.expr(f"impact div {STEP}").alias("step")).agg(F.count("*").alias("n"))
    deep = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    level = F.greatest(F.lit(0), F.ceil(F.log(deep / F.lit(DEPTH)) / F.log(F.lit(float(GROWTH)))))
    return counted.select("term", "step", level.cast("int").alias("level"))


def write_lists(postings: DataFrame) -> tuple[DataFrame, int]:
    """The postings by level, rows of a class side by side, and the number of levels."""
    spark = postings.sparkSession
    level = stored(levels(postings))
    deepest = level.agg(F.max("level")).first()[0] or 0
    # Per term the lowest step of each level but the last; a level of no steps lies above them all.
    lowest = [F.coalesce(F.min(F.when(F.col("level") <= i, F.col("step"))), F.lit(LAST_ID)).alias(f"low{i}") for i in range(deepest)]
    cuts = stored(level.groupBy("term").agg(F.max("step").alias("top"), *lowest))
    step = F.expr(f"impact div {STEP}")
    beyond = sum([(step < F.col(f"low{i}")).cast("int") for i in range(deepest)], F.lit(0))
    placed = postings.join(small_side(cuts, cuts.count()), "term").select(*CLASS, "term", "impact", beyond.alias("level"))
    folder = scratch_folder(spark)
    placed.sortWithinPartitions("level", *CLASS).write.partitionBy("level").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder), deepest + 1


def resolve(query: DataFrame, lists: DataFrame, depth: int) -> DataFrame:
    """Exact scores of the classes that may hold an item's best documents.

    ``query``: qid, term, weight. Returns qid, class, score.
    """
    tops = stored(lists.groupBy("term", "level").agg(F.max("impact").alias("top")))
    # Per item: tau and cut, the score and id of the tenth lower score so far, and whether it is closed.
    state = stored(query.select("qid").distinct().withColumns({"tau": F.lit(0).cast("long"), "cut": F.lit(LAST_ID), "closed": F.lit(False)}))
    followed: DataFrame | None = None
    ended: list[DataFrame] = []
    for level in range(depth):
        bound = tops.where(F.col("level") > level).groupBy("term").agg(F.max("top").alias("bound"))
        live = query.join(state.select("qid", "closed"), "qid").join(bound, "term", "left")
        live = stored(live.select("qid", "term", "weight", "closed", F.coalesce("bound", F.lit(0)).cast("long").alias("bound")))
        size = live.count()
        unread = live.groupBy("qid").agg(F.sum(F.col("weight") * F.col("bound")).alias("unread"))
        known = stored(state.select("qid", F.col("tau").alias("old")).join(unread, "qid"))
        read = lists.where(F.col("level") <= level).select(*CLASS, "term", "impact")
        columns = ["qid", *CLASS, "weight", "bound", "impact"]
        met = read.join(small_side(live.where("not closed"), size), "term").select(columns)
        if followed is not None:
            follow = read.join(small_side(live.where("closed"), size), "term").select(columns)
            met = met.union(follow.join(small_side(followed, followed.count()), ["qid", *CLASS], "left_semi"))
        sums = met.groupBy("qid", *CLASS).agg(
            F.sum(F.col("weight") * F.col("impact")).alias("lower"), F.sum(F.col("weight") * (F.col("impact") - F.col("bound"))).alias("gain")
        )
        ranged = sums.join(small_side(known, size), "qid").withColumn("upper", F.col("gain") + F.col("unread"))
        scored = stored(ranged.where("upper >= old and lower > 0").select("qid", *CLASS, "lower", "upper"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lower"), *CLASS))
        tenth = scored.withColumn("place", place).where(F.col("place") <= TOP).where(F.col("place") == TOP)
        tau = known.join(tenth.select("qid", "least", "lower"), "qid", "left")
        state = stored(
            tau.select(
                "qid",
                F.coalesce("lower", F.lit(0)).alias("tau"),
                F.coalesce("least", F.lit(LAST_ID)).alias("cut"),
                ((F.col("unread") == 0) | (F.col("unread") < F.coalesce("lower", F.lit(0)))).alias("closed"),
            )
        )
        may = scored.join(small_side(state.where("closed"), size), "qid")
        may = stored(may.where("upper > tau or (upper = tau and least <= cut)").select("qid", *CLASS, "lower", "upper"))
        open_ends = may.where("upper > lower").select("qid").distinct()
        closed = state.where("closed").select("qid")
        final = stored(closed.join(open_ends, "qid", "left_anti"))
        ended.append(may.join(final, "qid").select("qid", *CLASS, F.col("lower").alias("score")))
        followed = stored(may.join(final, "qid", "left_anti").select("qid", *CLASS))
        state = stored(state.join(final, "qid", "left_anti"))
        if not state.take(1):
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return stored(out)


def search(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """Per item its best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark: SparkSession = docs.sparkSession
    asked = stored(query_terms(items, item_col, item_text_col))
    vocabulary = stored(asked.select(F.col("term").alias("word"), "term").distinct())
    raw = stored(class_terms(docs, small_side(vocabulary, vocabulary.count()), id_col, text_col))
    total, length, longest = raw.agg(
        F.sum(F.when(F.col("first"), F.col("copies"))), F.sum(F.col("copies") * F.col("tf")), F.max("n")
    ).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    rare = raw.where("term is not null").groupBy("term").agg(F.sum("copies").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1))).cast("long")
    query = stored(asked.join(rare, "term").select("qid", "item_id", "term", (weight * F.col("times")).alias("weight")))
    lists, depth = write_lists(impacts(raw, total, length, longest))
    best = resolve(query.select("qid", "term", "weight"), lists, depth)
    # Of each class only the first ids can be among an item's best.
    winners = stored(best.select("h", "g").distinct())
    members = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.hash(text_col).alias("g")
    )
    order = F.asc_nulls_last("doc_id")
    some = members.join(small_side(winners, winners.count()), ["h", "g"]).withColumn("at", F.row_number().over(Window.partitionBy("h", "g").orderBy(order)))
    some = stored(some.where(F.col("at") <= TOP).select("doc_id", "h", "g"))
    ranked = best.join(small_side(some, some.count()), ["h", "g"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), order, "h"))
    )
    names = query.select("qid", "item_id").distinct()
    return ranked.where(F.col("rank") <= TOP).join(names, "qid").select("item_id", "rank", "doc_id", "score")
