"""License scans by diagonal voting.

Every run of K words of a text is joined by its hash to the positions at which license
templates hold it. A hit votes for a diagonal: the word at which the template would begin.
Votes are counted per diagonal, neighbouring diagonals (a few words put in or left out) are
merged, and the span of a merged diagonal is verified against the template's length.

Everything is DataFrame code: the texts are scanned once, in one pass of compiled stages, and
only hits and one row per text are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3  # words hashed together
DRIFT = 3  # words by which neighbouring diagonals may differ
COVERAGE = 0.75  # share of a template's word runs that a span must hold
STRETCH = 1.5  # length of a span, at most, in lengths of its template

# Fixed phrases of the base labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# License notices: label, words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; a null text has none.

    `lower` also changes letters beyond A-Z, but no template holds such letters, and the one
    of them that would become an ASCII letter by itself, the Kelvin sign, is replaced first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, SEPARATORS), "")


def gram_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(K)])


def template_positions(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """hash, words, template, label, is_phrase, runs (word runs of the template) and its position.

    As long as the list of templates; a template of fewer than K words is not allowed.
    """
    rows = [(i, label, text, i < len(phrases)) for i, (label, text) in enumerate([*phrases, *templates])]
    if any(len(text.split()) < K for _, _, text, _ in rows):
        raise ValueError(f"templates need at least {K} words")
    listed = spark.createDataFrame(rows, "template int, label string, notice string, is_phrase boolean")
    words = F.split("notice", " ")
    runs = F.size("t_words") - (K - 1)
    cut = listed.withColumn("t_words", words).withColumn("runs", runs)
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("t_at"))
    return cut.select(
        gram_hash(F.col("t_words"), F.col("t_at")).alias("t_hash"), F.slice("t_words", F.col("t_at") + 1, K).alias("t_gram"),
        "template", "label", "is_phrase", "runs", "t_at",
    )


def votes(docs: DataFrame, positions: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs one line with n_words, and one line for every hit of a template position.

    Rows are told apart by a number, so equal rows and null ids stay separate.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words")
    )
    last = F.greatest(F.size("words") - K, F.lit(-1))
    # Place -1 stands for the text itself; the others start a run of K words.
    placed = numbered.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    hashed = placed.withColumn("hash", F.when(F.col("at") >= 0, gram_hash(F.col("words"), F.col("at"))))
    joined = hashed.join(F.broadcast(positions), F.col("hash") == F.col("t_hash"), "left")
    same = F.lit(True)
    for j in range(K):
        same = same & (F.get("words", F.col("at") + j) == F.get("t_gram", F.lit(j)))
    return joined.where((F.col("at") < 0) | F.coalesce(same, F.lit(False))).select(
        "row", "doc_id", F.when(F.col("at") < 0, F.size("words")).cast("bigint").alias("n_words"), "template", "label",
        "is_phrase", "runs", (F.col("at") - F.col("t_at")).alias("diagonal"), "t_at",
    )


def scan_licenses(
    spark: SparkSession, docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of docs.

    A base place is a diagonal on which all runs of a phrase vote. `labels` adds those of the
    templates of which a merged diagonal holds at least `coverage` of the runs within a span of
    at most STRETCH template lengths; `score` is the best share of a template found, 1 for a
    whole phrase or notice and 0 where nothing votes. Null and empty texts have no words, no
    places and score 0; equal rows give one row each; only doc_id and text are read.
    """
    cast = votes(docs, template_positions(spark, phrases, templates))
    per_diagonal = cast.groupBy("row", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("is_phrase").alias("is_phrase"), F.first("runs").alias("runs"), F.count("t_at").alias("hits"),
        F.min(F.col("diagonal") + F.col("t_at")).alias("begin"), F.max(F.col("diagonal") + F.col("t_at") + K).alias("end"),
    )
    # A text's diagonals of one template, in order; a jump begins a new group of neighbours.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))
    neighbours = per_diagonal.withColumn("jump", jump.cast("int")).withColumn(
        "merged", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = F.col("is_phrase") & (F.col("hits") == F.col("runs"))
    merged = neighbours.groupBy("row", "template", "merged").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("runs").alias("runs"), F.sum("hits").alias("hits"), F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
    )
    share = F.least(F.lit(1.0), F.col("hits") / F.col("runs"))
    length = F.col("runs") + (K - 1)
    # Several occurrences close together share a group; then each of its lengths must be paid for.
    dense = F.col("end") - F.col("begin") <= STRETCH * length * F.greatest(F.lit(1.0), F.col("hits") / F.col("runs"))
    voted = F.when(dense, share).otherwise(F.least(share, F.lit(coverage / 2)))
    judged = merged.withColumn("share", F.when(F.col("template").isNotNull(), voted))
    found = F.when((F.col("share") >= coverage) | (F.col("n_base") > 0), F.col("label"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return judged.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.sum("n_base").cast("bigint").alias("n_base"), F.min("first_word").cast("bigint").alias("first_word"),
        F.max("last_word").cast("bigint").alias("last_word"),
        listed(F.when(F.col("n_base") > 0, F.col("label"))).alias("base_labels"), listed(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")
