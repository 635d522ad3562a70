"""Rows of (document, position, shingle) for joins on shingles, by DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

END = "_end"


def shingle_at(w: Column, i: Column, k: int) -> Column:
    """64-bit hash of k words from position i (from 0); a shorter tail hashes what is there."""
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def positions(w: Column, k: int) -> Column:
    """Hash per start of k whole words, and last a null that stands at the number of words."""
    n = F.size(w)
    return let(w, lambda v: F.concat(
        F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - k)), lambda i: shingle_at(v, i, k)))
        .otherwise(F.array().cast("array<bigint>")), F.array(F.lit(None).cast("bigint")),
    ))


def occurrences(docs: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """(ids…, pos, hash): a row per shingle, and per document one with a null hash.

    Carries no text: what is generated per word is ids, a position and a hash.
    ``n_words`` stands in the row with the null hash.
    """
    listed = docs.select(*ids, words(F.col("text")).alias("_w"))
    hashed = listed.select(*ids, F.size("_w").cast("bigint").alias("n_words"), positions(F.col("_w"), k).alias("_h"))
    rows = hashed.select(*ids, "n_words", F.posexplode("_h").alias("pos", "hash"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))
