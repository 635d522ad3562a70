"""Benchmark decontamination by a prefix-filtered join of shingle sets.

A window is ``length`` consecutive words of a benchmark item (a shorter item is
one window). Its shingles are ordered by rarity in the documents. A document
that contains the window has all its shingles, so one prefix token, the rarest,
is enough to find every candidate; the window must then fit between the start
and the end of the document, every shingle must stand at its own place, and the
words must be the same.

DataFrame functions only. Text is read once and never shuffled: documents are
cut into (doc, position, shingle) rows and those that no item has are dropped
in the scan by a broadcast join, whose side is checked to be small, or else by
a shuffled one. A passage in a third of all documents spreads over documents,
which is what the later steps are dealt by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import words
from .shingles import occurrences, positions

LENGTH = 10
MOST_SHINGLE = 4
BROADCAST_SHINGLES = 2_000_000  # rows of one bigint
BROADCAST_BYTES = 64 << 20


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(window, n, words, k): distinct windows and the words their shingles have, four or all of fewer."""
    w = benchmark.select(words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - length + 1))
    cut = w.select(F.explode(F.transform(starts, lambda i: F.slice("_w", i, length))).alias("words")).distinct()
    n = F.size("words")
    return cut.select(_name(F.col("words")).alias("window"), n.alias("n"), "words", F.least(n, F.lit(MOST_SHINGLE)).alias("k"))


def window_items(benchmark: DataFrame, length: int) -> DataFrame:
    """(window, item_id): a row per item that has the window."""
    w = benchmark.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - length + 1))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, length))).alias("words"))
    return cut.select(_name(F.col("words")).alias("window"), "item_id").distinct()


def _name(words_: Column) -> Column:
    return F.sha2(F.array_join(words_, " "), 256)


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast if its own bytes are few, counted."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _candidates(docs: DataFrame, key: list[str], windows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, window, n, start) wherever every k-word shingle of a window stands in its place; and (key, n_words)."""
    tokens_of = F.filter(positions(F.col("words"), k), lambda h: h.isNotNull())
    windows = windows.select("window", "n", tokens_of.alias("tokens"))
    tokens = stage(windows.select(F.explode("tokens").alias("hash")).distinct(), "item-tokens")
    side = tokens.withColumn("_known", F.lit(True))
    few = tokens.count() <= BROADCAST_SHINGLES
    met = stage(
        occurrences(docs, key, k).join(F.broadcast(side) if few else side, "hash", "left")
        .filter("_known or hash is null").drop("_known"), "met-shingles")
    found = met.filter("hash is not null").select(*key, "n_words", "pos", "hash")
    rarity = found.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    placed = windows.select("window", "n", F.posexplode("tokens").alias("offset", "hash"))
    # A window with a shingle that no document has cannot match: the inner join leaves it without that token.
    ranked = placed.join(rarity, "hash", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "hash")).alias("rarest")).filter("rarest.df > 0")
    prefix = stage(ranked.select("window", "n", "rarest.offset", "rarest.hash"), "prefixes")
    start = F.col("pos") - F.col("offset")
    maybe = found.join(_sent(prefix, F.lit(120)), "hash").select(*key, "window", "n", start.alias("start"), "n_words").filter(
        (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    body = _sent(windows.select("window", "tokens"), F.size("tokens") * 8 + 120)
    asked = maybe.distinct().join(body, "window").select(
        *key, "window", "n", "start", F.size("tokens").alias("_all"), F.posexplode("tokens").alias("_i", "hash")).withColumn("pos", F.col("start") + F.col("_i"))
    stands = found.select(*[F.col(c).alias(f"_{c}") for c in (*key, "pos", "hash")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col(c) == F.col(f"_{c}") for c in ("pos", "hash")]
    there = asked.join(stands, same, "left_semi").groupBy(*key, "window", "n", "start", "_all").agg(F.count(F.lit(1)).alias("_there"))
    every = met.filter("hash is null").groupBy(*key).agg(F.max("n_words").alias("n_words"))
    return there.filter("_there = _all").select(*key, "window", "n", "start"), every


def _confirmed(docs: DataFrame, key: list[str], sure: DataFrame, windows: DataFrame) -> DataFrame:
    """The places (key, window, n, start) at which the document has the window word for word."""
    known = _sent(windows.select("window", "words"), F.octet_length(F.array_join("words", " ")) + 120)
    # As many places as a document has words times windows that share a place: a group is one document.
    asked = sure.join(known, "window").groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(
        F.collect_list(F.struct("window", "n", "start", "words")).alias("_asked"))
    asked = stage(asked, "asked-places")
    size = F.aggregate("_asked", F.lit(0), lambda t, x: t + x["n"] * 12 + 100)
    met = docs.select(*key, words(F.col("text")).alias("_w")).join(_sent(asked, size), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    right = F.filter("_asked", lambda x: F.slice(F.col("_w"), (x["start"] + 1).cast("int"), x["n"]) == x["words"])
    return met.select(*key, F.explode(right).alias("_x")).select(*key, "_x.window", "_x.n", "_x.start").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, doc_key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row per document: its key, n_words, n_hit, n_items, items, items_sha256, contaminated.

    Shingles have four words; windows of fewer words (short items) are searched
    by themselves, with shingles of their own length, so they don't shorten
    those of others. Places where all shingles of a window stand, each a 64-bit
    hash, are confirmed word by word.

    Nulls: null text has no words and no hits; items without words are no
    windows; a null item_id is left out of the item list. Ties don't arise:
    every place counts. Rows with equal keys are one document. Very long texts
    are cut into rows in the scan; only the words of documents with candidates
    are looked at again. Columns that are not named here are not read. An empty
    benchmark hits nothing; no documents, no rows.
    """
    key = list(doc_key)
    windows = stage(item_windows(benchmark, length), "item-windows")
    # At most four: one per length of short items, and four words for all others.
    lengths = sorted({r["k"] for r in windows.select("k").distinct().collect()} | {MOST_SHINGLE})
    found, every = None, None
    for k in lengths:
        some, all_ = _candidates(docs, key, windows.filter(F.col("k") == k), k)
        found = some if found is None else found.unionByName(some)
        every = all_
    sure = stage(_confirmed(docs, key, found, windows), "confirmed-places")
    # Words in any window: a window adds what reaches beyond the ones that start before it.
    order = Window.partitionBy(*key).orderBy("start", "n")
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sure.withColumn("_new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(reach, "start")))
    covered = spans.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.sum("_new").alias("n_hit"))
    # A row per document and window, then per document and item: a window in very many items is no long array.
    owners = stage(window_items(benchmark, length), "window-items")
    named = sure.select(*key, "window").distinct().join(_sent(owners, F.lit(120)), "window").groupBy(*[F.col(c).alias(f"_i_{c}") for c in key]).agg(
        F.collect_set("item_id").alias("items"))
    out = every.join(covered, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").join(
        named, [F.col(c).eqNullSafe(F.col(f"_i_{c}")) for c in key], "left")
    names = F.sort_array(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    hit_words = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        *key, "n_words", hit_words.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), names.alias("items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit_words > 0).alias("contaminated"))
