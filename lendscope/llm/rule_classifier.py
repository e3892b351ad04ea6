"""Quality classifier as a sparse rule ensemble over text statistics.

Statistics of the text are native column expressions. A small forest is fitted on a bounded
sample of labelled rows; every path of its trees becomes a conjunctive rule, lasso logistic
regression keeps few of them, and the kept rules are compiled back into one column expression,
so scoring runs in the scan stage without Python or shuffles.

Defined cases: a null text counts as empty; a text without words has all statistics 0. Rows with
null ids are scored but never learnt from, and so are labels of other values than 0 and 1. Of
several labels of one id the largest counts. With fewer than two classes among the labels the
score is their smoothed mean for every row. Only the id and text columns are read, and those in ``keep``, whose
names must differ from the results'; repeated rows give repeated, equal results. An empty table gives no
rows; statistics are of whole texts of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forest and the weights are fitted on at most about this many labelled rows, by id hash.
SAMPLE_ROWS = 12_000
TREES, DEPTH, SEED = 10, 3, 7
LASSO = 0.003
HASH_RANGE = 1_000_000


def statistics(text: Column) -> dict[str, Column]:
    """First-level statistics, each one pass over the text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text),
        "words": F.size(words),
        "distinct_words": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")),
        "shouts": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")),
        "digits": F.regexp_count(text, F.lit(r"[0-9]+")),
        "pipes": F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))),
        "stops": F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))),
    }


#: Features as SQL over the first-level statistics.
FEATURES = {
    "log_words": "ln(1 + words)",
    "word_length": "coalesce(try_divide(chars, words), 0D)",
    "distinct_share": "coalesce(try_divide(distinct_words, words), 0D)",
    "distinct_root": "coalesce(try_divide(distinct_words, sqrt(words)), 0D)",
    "line_share": "coalesce(try_divide(distinct_lines, lines), 0D)",
    "words_per_line": "coalesce(try_divide(words, lines), 0D)",
    "symbol_share": "coalesce(try_divide(symbols, words), 0D)",
    "shout_share": "coalesce(try_divide(shouts, words), 0D)",
    "digit_share": "coalesce(try_divide(digits, words), 0D)",
    "pipe_share": "coalesce(try_divide(pipes, words), 0D)",
    "stop_share": "coalesce(try_divide(stops, words), 0D)",
}


def with_features(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    base = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    names = [c for c in base.columns if c != "_t"]
    counted = base.select(*names, *[c.alias(f"_{k}") for k, c in statistics(F.col("_t")).items()])
    stats = [k for k in statistics(F.lit(""))]
    plain = counted.select(*names, *[F.col(f"_{k}").alias(k) for k in stats])
    return plain.select(*names, *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()])


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class RuleModel:
    """Intercept and weighted conjunctions; a conjunction is a list of (feature, is_above, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for conditions, weight in self.rules:
            margin = margin + F.when(holds(conditions), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def holds(conditions) -> Column:
    """Whether a row meets a conjunction."""
    met = F.lit(True)
    for name, above, threshold in conditions:
        met = met & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
    return met


def _paths(node, names, path=()):
    """The conjunctions at all inner and leaf nodes below ``node``."""
    if path:
        yield path
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, threshold = names[split.featureIndex()], float(split.threshold())
    yield from _paths(node.leftChild(), names, (*path, (name, False, threshold)))
    yield from _paths(node.rightChild(), names, (*path, (name, True, threshold)))


def _simplified(path):
    """One bound per feature and side, so equal rules of different trees meet."""
    bounds = {}
    for name, above, threshold in path:
        best = bounds.get((name, above), threshold)
        bounds[name, above] = max(best, threshold) if above else min(best, threshold)
    return tuple(sorted((n, a, t) for (n, a), t in bounds.items()))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", folds=5) -> RuleModel:
    """Fit on labelled rows outside fold 0, at most about ``SAMPLE_ROWS`` of them."""
    usable = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & (fold("_id", folds) != 0))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    n = usable.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(HASH_RANGE)) < share * HASH_RANGE)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    names = list(FEATURES)
    rows = with_features(sample, "_text", [F.col("_id"), F.col("_y")]).repartition(4, "_id").persist()
    try:
        ones, count = rows.agg(F.sum("_y"), F.count("*")).first()
        ones = ones or 0.0
        if ones in (0.0, float(count)):
            mean = (ones + 1) / (count + 2)
            return RuleModel(math.log(mean / (1 - mean)), ())
        # Heap rows come in scan order; the order by id makes the fit repeatable.
        table = VectorAssembler(inputCols=names, outputCol="_x").transform(rows.coalesce(1).sortWithinPartitions("_id", *names))
        forest = RandomForestClassifier(
            featuresCol="_x", labelCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=10,
            featureSubsetStrategy="0.6",
        ).fit(table)
        found = dict.fromkeys(
            _simplified(p) for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names)
        )
        rules = list(found)
        marks = rows.select("_id", "_y", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        x = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(marks.coalesce(1).sortWithinPartitions("_id"))
        lasso = LogisticRegression(
            featuresCol="_x", labelCol="_y", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=25
        ).fit(x)
        weights = lasso.coefficients.toArray()
        return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: RuleModel, id_col="doc_id", text_col="text", threshold=0.3, folds=5, keep=()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row, then the columns named in ``keep``."""
    kept = [F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out")]
    table = with_features(docs, text_col, [*kept, *[F.col(c).alias(f"_keep_{c}") for c in keep]])
    return table.select("doc_id", "held_out", model.score().alias("score"), *[F.col(f"_keep_{c}").alias(c) for c in keep]).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
