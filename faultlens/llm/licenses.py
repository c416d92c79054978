"""License scans by diagonal voting.

Every rolling pair of document words is joined, by its hash, to the places of the same pair
in the license templates; for templates of three words and more the third word must agree
as well. A match votes for the diagonal "document place less template place". Votes are
counted per diagonal and neighbouring diagonals of a template (words added or dropped) are
merged into spans. A span is verified by the template words that it holds, each counted
once: enough of the template's runs of three words must be there, where words put between
those of a run do not break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.llm import common

# Phrases whose every place is reported, with their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Public license notices, as their owners ask to have them stated.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license version"),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
    ),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-notice", "licensed under a creative commons attribution"),
    ("cc-notice", "licensed under cc by"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Share of a template's places that a span must cover.
COVERAGE = 0.75
#: Diagonals at most so far apart belong to one span; a quarter of the template's places adds to it.
DRIFT = 6
#: A template's words are the bits of a long.
MOST_WORDS = 63
#: No word: marks the end of a document, so that each one has a row.
END = "\x00"


def _grams(spark: SparkSession) -> DataFrame:
    """Template, place, places in all, and the two or three words there. Fixed size."""
    rows = [(-1, "", 0, 1, END, None, None, False)]
    for n, (text, label) in enumerate(PHRASES):
        parts = text.split()
        rows.append((n, label, 0, 1, parts[0], parts[1], parts[2] if len(parts) > 2 else None, True))
    for n, (label, text) in enumerate(TEMPLATES, len(PHRASES)):
        parts = text.split()
        if len(parts) > MOST_WORDS:
            raise ValueError(f"template of more than {MOST_WORDS} words: {label}")
        for i in range(len(parts) - 2):
            rows.append((n, label, i, len(parts) - 2, *parts[i : i + 3], False))
    grams = spark.createDataFrame(
        rows, "template int, label string, place int, places int, t0 string, t1 string, t2 string, base boolean"
    )
    return grams.withColumn("gram", F.xxhash64("t0", "t1"))


def _hits(docs: DataFrame) -> DataFrame:
    """One row for each place of a template's words in a document, and one for its end."""
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(common.words("text"), F.array(F.lit(END))).alias("words"),
    )
    placed = keyed.select("row", "doc_id", "words", F.posexplode("words").alias("i", "w0"))
    w1, w2 = F.get("words", F.col("i") + 1), F.get("words", F.col("i") + 2)
    rolling = placed.withColumn("gram", F.xxhash64("w0", w1))
    same = (F.col("w0") == F.col("t0")) & F.col("t1").eqNullSafe(w1) & (F.col("t2").isNull() | (F.col("t2") == w2))
    grams = F.broadcast(_grams(docs.sparkSession).withColumnRenamed("gram", "key"))
    return rolling.join(grams, (F.col("gram") == F.col("key")) & same).select(
        "row", "doc_id", "template", "label", "base", "places", "i", "place"
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License phrases and notices of every whole text.

    Returns doc_id, n_words, n_base (places of all base phrases), first_word and last_word
    (their least and greatest start, null without any), base_labels, labels (those of the
    verified template spans too), score (coverage of the best span, 1 where a base phrase
    stands) and n_spans (verified spans of templates).

    A null text counts as empty. Every input row gives a result row, repeated rows and
    null doc_ids included; texts may be of any length. Further columns are ignored; no
    input gives no rows.
    """
    votes = (
        _hits(docs)
        .withColumn("diagonal", F.col("i") - F.col("place"))
        .groupBy("row", "template", "diagonal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("label").alias("label"),
            F.first("base").alias("base"),
            F.first("places").alias("places"),
            F.bit_or(F.expr("shiftleft(7L, place)")).alias("held"),
        )
    )
    # Diagonals of a template that lie close together are one span.
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT + F.floor(F.col("places") / 4)
    spans = (
        votes.withColumn("fresh", F.when(F.col("base") | (F.col("template") < 0) | F.coalesce(fresh, F.lit(True)), 1).otherwise(0))
        .withColumn("span", F.sum("fresh").over(along))
        .groupBy("row", "template", "span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("label").alias("label"),
            F.first("base").alias("base"),
            F.min("diagonal").alias("start"),
            F.first("places").alias("places"),
            F.bit_or("held").alias("held"),
        )
        # Places whose three words are all held, by whichever runs.
        .withColumn("runs", F.col("held").bitwiseAND(F.shiftright("held", 1)).bitwiseAND(F.shiftright("held", 2)))
        .withColumn("coverage", F.when(F.col("base"), F.lit(1.0)).otherwise(F.bit_count("runs") / F.col("places")))
    )

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    base, end = F.col("base"), F.col("template") < 0
    verified = ~base & ~end & (F.col("coverage") >= COVERAGE)
    return (
        spans.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max(F.when(end, F.col("start"))).cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(base | verified).alias("labels"),
            F.coalesce(F.max(F.when(~end, F.col("coverage"))), F.lit(0.0)).alias("score"),
            F.count(F.when(verified, 1)).alias("n_spans"),
        )
        .drop("row")
    )
