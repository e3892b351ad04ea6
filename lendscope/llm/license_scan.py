"""License scan by diagonal voting, with DataFrame functions only.

All rolling word pairs of the documents are joined, by hash and then by the words themselves, to the
positions of the same pairs in license templates. Hits vote for their diagonal (document position
minus template position); neighbouring diagonals of a template, which differ by inserted or dropped
words, merge into one span. Templates that are short phrases count only where every pair of one
diagonal is there; a span of a longer template counts if it covers ``MIN_COVER`` of its pairs. Pairs
are the k-grams because the shortest phrases are two words long.

The broadcast side is the fixed template table. Defined cases: null texts count as empty; rows that
repeat an id and a text get the same result; null ids are kept; further columns, whatever their names,
are not read; an empty table gives no rows; a text of any length is split whole in its own row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.llm.common import KEY, keyed

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of public licenses, and their labels.
TEMPLATES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "You may not use this file except in compliance with the License": "apache",
    "This work is licensed under the GNU General Public License, version 3": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License": "gpl",
    "GNU Lesser General Public License": "lgpl",
    "GNU Affero General Public License": "agpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
}
MIN_COVER = 0.8
#: Diagonals that differ by at most so many words merge, across gaps of at most so many words.
NEAR, GAP = 3, 12
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        phrase = text in PHRASES
        rows += [(number, label, phrase, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, pairs int, at int, first string, second string")
    return table.withColumn("hash", F.xxhash64("first", "second"))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_words``; of the characters that lower() changes to ASCII, only the Kelvin sign is no A-Z."""
    return docs.withColumn("_words", F.array_remove(F.split(F.lower("_text"), SEPARATORS), "")).drop("_text")


def hits(docs: DataFrame) -> DataFrame:
    """Template positions met: key, ``pos``, and the template's columns."""
    zipped = F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("v"))
    # The outer variant adds no filter that would evaluate the words again.
    pairs = with_words(docs).select(*KEY, F.posexplode_outer(zipped).alias("pos", "pair"))
    hashed = pairs.select(*KEY, "pos", F.col("pair.w").alias("w"), F.col("pair.v").alias("v")).withColumn("hash", F.xxhash64("w", "v"))
    table = template_pairs(docs.sparkSession)
    return hashed.join(F.broadcast(table), "hash").where("w = first and v = second")


def license_spans(docs: DataFrame) -> DataFrame:
    """Verified places: key, ``label``, ``phrase``, ``start`` (word), ``cover``."""
    votes = hits(docs).groupBy(*KEY, "template", "label", "phrase", "pairs", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("ats")
    )
    phrases = votes.where("phrase and size(ats) = pairs").select(*KEY, "label", "phrase", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy(*KEY, "template").orderBy("low", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > NEAR) | (F.col("low") - F.lag("high").over(by) > GAP)
    spans = (
        votes.where("not phrase")
        .withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "template", "label", "phrase", "pairs", "span")
        .agg(F.min("low").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("met"))
        .select(*KEY, "label", "phrase", "start", (F.col("met") / F.col("pairs")).alias("cover"))
    )
    return phrases.unionByName(spans)


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document with its counts, labels and best cover as score."""
    rows = keyed(docs, id_col, text_col)
    base = F.col("phrase")
    verified = base | (F.col("cover") >= MIN_COVER)
    found = (
        license_spans(rows)
        .groupBy(F.col("_id").alias("f_id"), F.col("_fp").alias("f_fp"))
        .agg(
            F.count_distinct(F.when(base, F.struct("label", "start"))).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    counted = with_words(rows).select(*KEY, F.size("_words").cast("long").alias("n_words"))
    joined = counted.join(found, counted._id.eqNullSafe(found.f_id) & (counted._fp == found.f_fp), "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
