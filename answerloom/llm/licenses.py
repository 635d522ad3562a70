"""License scan by diagonal voting.

Every rolling k-gram of words in a document is joined to the positions where a
template has the same k-gram. A hit votes for the diagonal (document position
minus template position). Votes are counted per document, template and
diagonal; neighbouring diagonals, which an inserted or missing word puts beside
each other, are merged; the span they cover is checked against the template.

DataFrame functions only. The text is read once and never shuffled: what the
join lets through are a few votes. The templates are a parameter of known size,
so they are broadcast. A hot template or k-gram only makes more (document,
template, diagonal) groups, all of them small and counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import words
from .shingles import occurrences

K = 2
BAND, WORDS_A_GAP = 3, 8  # words put in or left out that a run bears, and how many more for that many words of template

# Phrases whose every place counts, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Statements found by their span, with their labels.
TEMPLATES = (
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl-notice"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit-grant"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
)


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(hash, template, exact, label, length, at): a row per position of a k-gram in a template."""
    rows = [(i, exact, label, text) for i, (text, label, exact) in enumerate(
        [(t, l, True) for t, l in phrases] + [(t, l, False) for t, l in templates])]
    named = spark.createDataFrame(rows, "template int, exact boolean, label string, text string")
    sized = named.withColumn("length", F.size(words(F.col("text"))))
    found = occurrences(sized, ["template", "exact", "label", "length"], K).filter("hash is not null")
    return found.select("hash", "template", "exact", "label", "length", F.col("pos").alias("at"))


def scan(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
    *, band: int = BAND, coverage: float = 0.7, ids: Sequence[str] = ("doc_id",),
) -> tuple[DataFrame, DataFrame]:
    """(hits, spans).

    ``hits`` has a row per document: ids, n_words, n_base, first_word, last_word,
    base_labels, labels, score. ``spans`` has a row per place: ids, label, exact,
    first, last (words, both included), coverage. Phrases need every k-gram on
    one diagonal, so their places are exact (but for equal 64-bit hashes of
    different words); a template needs ``coverage`` of its distinct k-grams on
    diagonals of which neighbours lie at most ``band`` apart, and one more for
    each eight words of the template. ``score`` is the best coverage.

    Phrases and templates have at least two words. Null text has no words and
    matches nothing. Rows with equal ids are taken together as one document.
    Very long texts are cut into rows in the scan. Ties don't arise: every place
    counts. No other column is read. Empty input gives no rows.
    """
    spark = docs.sparkSession
    ids = list(ids)
    grams = template_grams(spark, phrases, templates)
    # Unmatched k-grams go at once; the row with the null hash stays for every document.
    met = occurrences(docs, ids, K).join(F.broadcast(grams), "hash", "left").filter("template is not null or hash is null")
    votes = met.withColumn("diagonal", F.col("pos") - F.col("at"))
    per_diagonal = votes.groupBy(*ids, "template", "exact", "label", "length", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at"))
    # Exact phrases keep diagonals apart; others join a run while the gap is at most the band.
    along = Window.partitionBy(*ids, "template").orderBy("diagonal", "first")
    wide = F.lit(band) + F.floor(F.col("length") / WORDS_A_GAP)
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.col("first") - F.lag("last").over(along)
    new = F.when(gap.isNull() | F.col("exact") | (gap > wide) | (F.abs(apart) > F.col("length")), 1).otherwise(0)
    merged = per_diagonal.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along)).groupBy(
        *ids, "template", "exact", "label", "length", "_run").agg(
        F.max("n_words").alias("n_words"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / (F.max("length") - K + 1)).alias("coverage"))
    verified = F.col("template").isNotNull() & F.when(F.col("exact"), F.col("coverage") >= 1.0).otherwise(F.col("coverage") >= coverage)
    base = verified & F.col("exact")

    def joined(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    hits = merged.groupBy(*ids).agg(
        F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), joined(base).alias("base_labels"), joined(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("coverage"))), F.lit(0.0)).alias("score"))
    spans = merged.filter(verified).select(*ids, "label", "exact", "first", "last", "coverage")
    return hits, spans
