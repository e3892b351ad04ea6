"""User tag frequencies, selection and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lendscope.operators.ranking import latest_per_key

# Document-frequency limits of the text features.
MIN_DOCUMENTS = 10
MAX_DOCUMENT_SHARE = 0.9
# Band of the important tags, both ends open.
IMPORTANT_LOW, IMPORTANT_HIGH = 0.3, 0.8
# Words of two or more letters, digits or underscores of any script.
WORD_PATTERN = r"(?U)\b\w\w+\b"


def latest_tags(user_taglist: DataFrame) -> DataFrame:
    newest = latest_per_key(user_taglist, "user_id", "insertdate")
    return newest.withColumnRenamed("insertdate", "tag_insert_date")


def exploded_tags(tags: DataFrame) -> DataFrame:
    """One row per occurrence of a tag."""
    return tags.select("user_id", F.explode(F.split("taglist", r"[|]")).alias("tag"))


def tag_frequency(tags: DataFrame) -> DataFrame:
    """Occurrences of each tag and its share of the users, rounded to five digits."""
    users = tags.agg(F.count(F.lit(1))).scalar()
    return (
        exploded_tags(tags)
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.round(F.col("n") / users, 5))
    )


def top_tags(frequency: DataFrame, k: int = 150) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "tag").limit(k)


def important_tags(frequency: DataFrame) -> DataFrame:
    share = F.col("share")
    return frequency.filter((share > IMPORTANT_LOW) & (share < IMPORTANT_HIGH))


def tag_tokens(tags: DataFrame) -> DataFrame:
    """Tag list with bars as blanks, split on white space."""
    text = F.trim(F.replace(F.trim("taglist"), F.lit("|"), F.lit(" ")))
    return tags.select("user_id", F.split(text, r"\s+").alias("tokens"))


def word_counts(tags: DataFrame) -> DataFrame:
    """Occurrences of each lower-case word in each user's tag list."""
    words = F.regexp_extract_all(F.lower("taglist"), F.lit(WORD_PATTERN), F.lit(0))
    return (
        tags.select("user_id", F.explode(words).alias("word"))
        .groupBy("user_id", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(tags: DataFrame) -> DataFrame:
    """Words with their document frequency, within the limits at both ends."""
    documents = tags.agg(F.count(F.lit(1))).scalar()
    # Counting ``n`` keeps this the same aggregate as in ``bag_of_words``, so Spark runs it once.
    frequency = word_counts(tags).groupBy("word").agg(F.count("n").alias("n_documents"))
    return (
        frequency.withColumn("documents", documents)
        .filter(F.col("n_documents") >= MIN_DOCUMENTS)
        .filter(F.col("n_documents") <= MAX_DOCUMENT_SHARE * F.col("documents"))
    )


def bag_of_words(tags: DataFrame) -> DataFrame:
    """Counts of the vocabulary's words per user.

    A word may occur for most users: an inner join, so that Spark can split its partition.
    """
    return word_counts(tags).join(vocabulary(tags), "word")


def tf_idf(tags: DataFrame) -> DataFrame:
    """Smoothed TF-IDF per user and word, scaled to unit length per user.

    A user's words are at most the vocabulary, so the window per user is small.
    """
    idf = F.log((1 + F.col("documents")) / (1 + F.col("n_documents"))) + 1
    weighted = bag_of_words(tags).withColumn("weight", F.col("n") * idf)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("user_id")))
    return weighted.select("user_id", "word", (F.col("weight") / length).alias("tfidf"))


def word_positions(words: DataFrame, digits: int = 3) -> DataFrame:
    """Each word of ``words`` with its ``place`` in the order of its hash, from 0.

    A place is the number of words in earlier hash buckets plus the number within the bucket, so only
    the bucket counts (16 to the power ``digits``) meet in one task.
    """
    hashed = words.select("word", F.md5(F.col("word").cast("binary")).alias("_hash")).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", "word"))
    return hashed.join(starts, "_bucket").select("word", (F.col("_start") + within - 1).alias("place"))


def feature_coordinates(stats: DataFrame, dense: list[str], tags: DataFrame) -> DataFrame:
    """Dense columns and word counts of each user in ``stats`` as ``user_id``, ``position``, ``value``.

    Positions are the dense columns in order, then the vocabulary's words. Users without tags keep
    their dense values.
    """
    columns = F.array(
        *[F.struct(F.lit(i).cast("long").alias("position"), F.col(c).cast("double").alias("value")) for i, c in enumerate(dense)]
    )
    counts = bag_of_words(tags)
    sparse = counts.join(word_positions(vocabulary(tags)), "word").join(stats.select("user_id"), "user_id", "left_semi")
    return stats.select("user_id", F.inline(columns)).unionByName(
        sparse.select("user_id", (F.col("place") + len(dense)).alias("position"), F.col("n").cast("double").alias("value"))
    )
