"""License scans by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import ascii_lower, values

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place counts.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Openings of public license texts and notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]

#: Diagonals with fewer votes take no part in merging; diagonals this close belong together.
MIN_VOTES, MERGE = 3, 3
#: Least share of a notice's grams in a span, and the span's greatest length in notice lengths.
COVERAGE, STRETCH = 0.6, 1.5


def words_of(text: Column) -> Column:
    """Words of the A-Z lower-cased text; null counts as empty."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_grams(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Every word pair of every template with its place: `h, a, b, tid, tpos`; as large as the templates."""
    texts = [(i, t) for i, (_, t) in enumerate([*phrases, *notices])]
    words = values(spark, ["tid", "text"], texts).select("tid", F.split("text", " ").alias("w"))
    grams = words.select("tid", "w", F.posexplode("w").alias("tpos", "a")).withColumn("b", F.get("w", F.col("tpos") + 1))
    return grams.where("b IS NOT NULL").select(F.xxhash64("a", "b").alias("h"), "a", "b", "tid", F.col("tpos").cast("long").alias("tpos"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Find license phrases and notices in whole texts of `doc_id, text`.

    Every word pair of a text is looked up by its hash among the pairs of all templates (a broadcast
    of the fixed templates, inside the scan's own stage). A hit at word p on template place t votes for
    the diagonal p - t; only hits are shuffled. A phrase stands where its diagonal has a vote for each
    of its pairs. For notices, diagonals of MIN_VOTES or more that lie within MERGE of each other are
    merged (words put in or left out), and a span stands when it holds COVERAGE of the notice's pairs
    within STRETCH of its length. Words are compared as well as hashes, so a place is exact.

    One row per input row: `doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`.
    Null or empty text: no words, no labels, score 0. Repeated rows each keep a row; other columns
    of the input are not read.
    """
    spark = docs.sparkSession
    listed = [*phrases, *notices]
    info = values(
        spark, ["tid", "label", "is_base", "n_grams", "n_template"],
        [(i, label, i < len(phrases), len(text.split()) - 1, len(text.split())) for i, (label, text) in enumerate(listed)],
    )
    grams = template_grams(spark, phrases, notices)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(F.col("text")).alias("words"))
    places = words.select(
        "row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "w")
    ).select("row", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"), "w", F.get("words", F.col("pos") + 1).alias("x"))
    places = places.withColumn("hash", F.xxhash64("w", "x"))
    hit = (F.col("hash") == F.col("h")) & (F.col("w") == F.col("a")) & (F.col("x") == F.col("b"))
    # A text's first word stays as well, so that texts without hits keep their row in the same pass.
    hits = places.join(F.broadcast(grams), hit, "left").where("tid IS NOT NULL OR pos IS NULL OR pos = 0")
    votes = hits.groupBy("row", "doc_id", "n_words", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("tpos").alias("tpos")
    )
    votes = votes.join(F.broadcast(info), "tid", "left")
    strong = F.coalesce(F.when(F.col("is_base"), F.col("votes") == F.col("n_grams")).otherwise(F.col("votes") >= MIN_VOTES), F.lit(False))
    votes = votes.withColumn("strong", strong)
    by_template = Window.partitionBy("row", "tid", "strong").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_template)
    votes = votes.withColumn("apart", F.coalesce((F.col("is_base") | (apart > MERGE)).cast("long"), F.lit(0)))
    votes = votes.withColumn("span", F.sum("apart").over(by_template))
    spans = votes.groupBy("row", "doc_id", "n_words", "tid", "strong", "span", "label", "is_base", "n_grams", "n_template").agg(
        F.min("diagonal").alias("start"), (F.max("last") - F.min("first") + 2).alias("length"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("strong"), F.col("tpos")))))).alias("covered"),
    )
    covered = F.col("covered") / F.col("n_grams")
    verified = F.col("strong") & ~F.col("is_base") & (covered >= COVERAGE) & (F.col("length") <= STRETCH * F.col("n_template"))
    base = F.col("strong") & F.col("is_base")
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base | verified).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(verified, covered)), F.lit(0.0)).alias("score"),
    ).drop("row")
