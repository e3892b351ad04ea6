"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each of ``SAMPLES`` samples every term
draws r and c from Gamma(2, 1) and b from [0, 1), always the same for the same term and sample; with weight
w it gets t = floor(ln w / r + b) and a = c * exp(-r * (t - b + 1)), and the sample is the (term, t) with the
least a. Two texts share a sample with a probability equal to their generalised Jaccard similarity, the sum
of the lesser over the sum of the greater weights. A fingerprint lists the samples as 31-bit numbers; likeness
is the share of equal places (two texts without words: 1, only one of them without: 0).

The draws come from the 60 leading bits of a word's MD5 by multiply-and-shift hashing. The order by ln a is
kept to 2^-24; the sample's number settles the rest, alike for all texts.

``edited`` gives each document's text with its second half replaced by the beginning of the next document.
Texts are shuffled once by id and hash, beginnings once to the document before; words are counted and samples
drawn in the tasks that then hold the texts, so a row's memory is that of its own words.

Defined cases: null texts are empty; null ids come last; of equal ids the text's hash decides the order; rows
that repeat id and text are one document in that order and are returned each; a single document is its own
next one; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import ascii_lower, split_words, stored
from lendscope.operators.numbering import dense_numbers

SAMPLES = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Multipliers of the draws: powers of this generator modulo a prime.
GENERATOR, PRIME = 48271, (1 << 31) - 1
#: Places of ln a kept, and the bits of a sample's number.
FINE, NUMBER_BITS = 1 << 24, 31
KEY = ["id_key", "no_id", "fp"]


def multipliers() -> Iterator[int]:
    a = GENERATOR
    while True:
        a = a * GENERATOR % PRIME
        yield a


def sample_sql(numbers: Iterator[int], weight: str) -> str:
    """One term's entry for the next sample, in SQL that DuckDB reads as well.

    ``x`` and ``y`` are 30-bit halves of the word's hash and ``weight`` names ln w. Each of three hashed
    numbers gives two 15-bit draws; the product of two draws makes a Gamma(2, 1) variable.
    """

    def bits() -> str:
        return f"(({next(numbers)} * x + {next(numbers)} * y + {next(numbers)}) >> 20)"

    def gamma(v: str) -> str:
        return f"(-ln((({v} >> 15 & 32767) + 0.5) * (({v} & 32767) + 0.5) / 1073741824.0))"

    r, c, b = gamma(bits()), gamma(bits()), f"((({bits()} & 32767) + 0.5) / 32768.0)"
    t = f"cast(floor({weight} / {r} + {b}) as bigint)"
    order = f"cast(floor((ln({c}) - {r} * ({t} - {b} + 1) + 128) * {FINE}) as bigint)"
    return f"({order} * {1 << NUMBER_BITS} + ((31 * x + y + 104729 * {t}) & {(1 << NUMBER_BITS) - 1}))"


def spark_sql(expression: str) -> Column:
    """Literals with a point are decimals in Spark and become doubles here."""
    return F.expr(re.sub(r"(\d+\.\d+)", r"\1D", expression))


def signatures(bodies: DataFrame, keys: list[str], variants: list[str], samples: int = SAMPLES) -> DataFrame:
    """Per row of ``bodies`` the samples of each text column in ``variants``, null where it has no words.

    ``keys`` tell the rows apart; if ``bodies`` is partitioned by some of them, nothing is shuffled.
    """
    stack = ", ".join(f"{i}, {name}" for i, name in enumerate(variants))
    each = bodies.select(*keys, F.expr(f"stack({len(variants)}, {stack}) as (variant, body)"))
    words = each.select(*keys, "variant", F.explode_outer(split_words(F.col("body"), SEPARATORS)).alias("word"))
    counts = [F.sum((F.col("variant") == i).cast("long")).alias(f"w{i}") for i in range(len(variants))]
    terms = words.withColumn("word", ascii_lower(F.col("word"))).groupBy(*keys, "word").agg(*counts)
    hashed = terms.withColumn("hash", F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long"))
    drawn = hashed.select(
        *keys,
        F.shiftright("hash", 30).alias("x"),
        F.col("hash").bitwiseAND((1 << 30) - 1).alias("y"),
        # ln 0 is null: a word that a variant lacks takes no part in its samples.
        *[F.ln(F.col(f"w{i}").cast("double")).alias(f"w{i}") for i in range(len(variants))],
    )
    least = []
    for i in range(len(variants)):
        numbers = multipliers()
        least += [F.min(spark_sql(sample_sql(numbers, f"w{i}"))).alias(f"s{i}_{k}") for k in range(samples)]
    number = lambda name: F.col(name).bitwiseAND((1 << NUMBER_BITS) - 1).cast("int")
    lists = [
        F.when(F.col(f"s{i}_0").isNotNull(), F.array(*[number(f"s{i}_{k}") for k in range(samples)])).alias(name)
        for i, name in enumerate(variants)
    ]
    return drawn.groupBy(*keys).agg(*least).select(*keys, *lists)


def likeness(one: str, other: str) -> Column:
    """Share of equal samples."""
    same = F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda x: x)) / F.size(one)
    return F.when(F.col(one).isNull() & F.col(other).isNull(), 1.0).when(F.col(one).isNull() | F.col(other).isNull(), 0.0).otherwise(same)


def digest(samples: str) -> Column:
    hexed = F.transform(samples, lambda v: F.lpad(F.hex(v.cast("long")), 8, "0"))
    return F.coalesce(F.array_join(hexed, ""), F.lit(""))


def in_order(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each document's key, length, copies and place, and the key and half length of the one before it."""
    narrow = rows.groupBy(*KEY).agg(F.first(F.length("text")).cast("long").alias("n"), F.count("*").alias("copies"))
    placed = stored(dense_numbers(narrow, [F.col("no_id"), F.col("id_key"), F.col("fp")], "place"))
    total = placed.count()
    after = F.when(F.col("place") == total - 1, 0).otherwise(F.col("place") + 1)
    before = placed.select(after.alias("place"), *[F.col(k).alias(f"prev_{k}") for k in KEY], F.floor(F.col("n") / 2).alias("prev_half"))
    return stored(placed.join(before, "place")), total


def edited(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Per document its key, text and edited text."""
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    tails = texts.join(linked, KEY).select(
        *[F.col(f"prev_{k}").alias(k) for k in KEY], F.col("text").substr(F.lit(1), F.col("prev_half").cast("int")).alias("tail")
    )
    own = texts.join(linked, KEY).select(*KEY, "text", F.col("text").substr(F.lit(1), F.col("n").cast("int") - half).alias("head"))
    return own.join(tails, KEY).select(*KEY, "text", F.concat("head", "tail").alias("edited"))


def fingerprint(docs: DataFrame, id_col="doc_id", text_col="text", samples: int = SAMPLES) -> DataFrame:
    """Per document its fingerprint, its edited text's, and their likeness to each other and to the next document's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = plain.select(F.coalesce("id", F.lit(0)).alias("id_key"), F.col("id").isNull().alias("no_id"), F.xxhash64("text").alias("fp"), "text")
    linked, total = in_order(rows)
    bodies = edited(rows, linked).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    signed = signatures(bodies, [*KEY, "sha"], ["text", "edited"], samples)
    signed = stored(signed.join(linked.select(*KEY, "n", "copies", "place"), KEY))
    ahead = F.when(F.col("place") == 0, total - 1).otherwise(F.col("place") - 1)
    following = signed.select(ahead.alias("place"), F.col("text").alias("next"))
    return signed.join(following, "place").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.when(~F.col("no_id"), F.col("id_key")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        digest("text").alias("fingerprint"),
        digest("edited").alias("edited_fingerprint"),
        likeness("text", "edited").alias("near_edited"),
        likeness("text", "next").alias("near_next"),
    )
