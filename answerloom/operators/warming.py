"""What is asked for often, and of that, what is not stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.entries import micros
from ..functions.text import preview
from ..session import beside
from .lookup import live, missing

DAY_US = 24 * 3600 * 1_000_000


def popular_items(log: DataFrame, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
    """Top keys by accesses; ``recent_accesses`` within a day of the key's own last access.

    ``among``: a bounded table of the keys that come into question.
    """
    if among is not None:
        named = among.select(F.col("key").alias("_named"))
        log = log.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("_named")), "left_semi")
    counts = log.groupBy("key").agg(
        F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access"),
        F.min(F.struct("ts", "seq")).alias("_first"),
    )
    top = counts.orderBy(F.col("access_count").desc(), "_first").limit(limit)
    # ``limit`` rows: safe to send everywhere, and the log is not shuffled.
    near = micros(F.col("ts")) > micros(F.col("last_access")) - DAY_US
    return (
        log.select("key", "ts").join(F.broadcast(top), "key")
        .groupBy("key", "access_count", "last_access")
        .agg(F.count_if(near).alias("recent_accesses"))
    )


def frequent_queries(log: DataFrame, entries: DataFrame, now, limit: int = 10) -> DataFrame:
    counts = log.groupBy("query").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("ts", "seq")).alias("_first"))
    top = counts.orderBy(F.col("frequency").desc(), "_first").limit(limit).drop("_first")
    held = live(entries, now).filter("level = 'result'").select(F.col("key").alias("query"), F.lit(True).alias("_held"))
    # ``limit`` rows on one side.
    return (
        held.join(F.broadcast(top), "query", "right")
        .select("query", "frequency", F.coalesce("_held", F.lit(False)).alias("cached"))
    )


def _frequent(counts: DataFrame, share: float) -> DataFrame:
    """Rows above a share of the total: fewer than 1/share of them."""
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.filter(F.col("n") > total * share)


def warming_recommendations(
    log: DataFrame, queries: DataFrame, entries: DataFrame, now, item_share=0.1, query_share=0.05
) -> DataFrame:
    """Frequent keys and queries without a live entry. ``queries`` has a ``query`` column."""
    items = _frequent(log.groupBy("key").agg(F.count(F.lit(1)).alias("n")), item_share)
    asked = _frequent(queries.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("n")), query_share)
    lost = missing(items, entries, now, auto=True)
    unanswered = missing(asked.withColumn("level", F.lit("result")), entries, now)
    item, short = F.col("key"), preview(F.col("key"))
    return lost.select(
        F.lit("popular_item").alias("type"), F.lit("high").alias("priority"),
        F.format_string('Item "%s" is frequently accessed but not cached', item).alias("message"),
        F.format_string('Consider pre-loading item "%s"', item).alias("action"),
    ).unionByName(unanswered.select(
        F.lit("frequent_query").alias("type"), F.lit("medium").alias("priority"),
        F.format_string('Query "%s..." is frequent but not cached', short).alias("message"),
        F.format_string('Consider pre-computing result for "%s..."', short).alias("action"),
    ))


def strategies_due(strategies: DataFrame, now) -> DataFrame:
    """(name, enabled, frequency, last_run): enabled and not run for ``frequency`` seconds."""
    waited = (micros(F.lit(now)) - F.coalesce(micros(F.col("last_run")), F.lit(0))) / 1e6
    return strategies.filter(F.col("enabled") & (waited >= F.col("frequency")))


def warming_stats(log: DataFrame, queries: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row: keys and queries tracked, and how the runs (name, ok) of strategies went."""
    out = log.agg(
        F.count_distinct("key").alias("access_patterns_tracked"), F.count(F.lit(1)).alias("accesses"),
        F.max("ts").alias("last_access"),
    )
    if queries is not None:
        out = beside(out, queries.agg(F.count_distinct("query").alias("query_patterns_tracked")))
    if runs is not None:
        out = beside(out, runs.agg(
            F.count_distinct("name").alias("strategies_run"), F.count_if("ok").alias("successful_warmings"),
            F.count_if(~F.col("ok")).alias("failed_warmings")))
    return out
