"""Deciding which entries are out of date, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.entries import micros, percent, ttl_for
from ..schemas import LEVELS, RULES
from ..session import beside, broadcast_if_small
from .similarity import drift

# The default rules.
DEFAULT_RULES = [
    ("model_version", 0.0, "invalidate", ["result", "generation"], "Invalidate when model version changes"),
    ("corpus_change", 0.0, "invalidate", ["context", "retrieval"], "Invalidate when corpus changes"),
    ("semantic_drift", 0.1, "refresh", ["query", "embedding"], "Refresh when semantic drift detected"),
    ("time_based", 86400.0, "warn", ["all"], "Warn about old entries"),
]


VERSION_SPAN = (1 << 61) - 1  # a corpus version has 61 bits


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES)


def rule_threshold(rules: DataFrame, rule_type: str):
    """The smallest threshold of a kind of rule, as a value to compare with; null, so never reached, without one."""
    return rules.filter(F.col("rule_type") == rule_type).agg(F.min("threshold").alias("threshold")).scalar()


def changed_versions(versions: DataFrame) -> DataFrame:
    """(rule_type, level) whose stored version differs from the current one.

    ``versions``: (kind model/corpus, level, stored, current).
    """
    rule = F.when(F.col("kind") == "model", "model_version").otherwise("corpus_change")
    return versions.filter(~F.col("stored").eqNullSafe(F.col("current"))).select(rule.alias("rule_type"), "level")


def apply_rules(triggers: DataFrame, rules: DataFrame) -> DataFrame:
    """Triggers (rule_type, level) that a rule covers, with its action.

    """
    covers = F.expr("array_contains(affected_levels, level) or array_contains(affected_levels, 'all')")
    return (
        triggers.join(broadcast_if_small(rules), "rule_type").filter(covers)
        .select("rule_type", "level", "action", "description")
    )


def _dropped_levels(actions: DataFrame) -> DataFrame:
    """Names of the levels to drop: as many rows as there are levels at most, so they are broadcast."""
    gone = actions.filter("action = 'invalidate'").filter(F.col("level").isin(*LEVELS))
    return F.broadcast(gone.select("level").distinct())


def invalidate(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """Entries left after dropping every level with an ``invalidate`` action."""
    return entries.join(_dropped_levels(actions), "level", "left_anti")


def invalidated(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """The entries that :func:`invalidate` drops."""
    return entries.join(_dropped_levels(actions), "level", "left_semi")


def corpus_version(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row ``version``: the same for the same set of texts in any order."""
    part = F.conv(F.substring(F.md5(F.encode(F.col(text), "UTF-8")), 1, 15), 16, 10).cast("decimal(38,0)")
    return documents.agg((F.coalesce(F.sum(part), F.lit(0)) % VERSION_SPAN).cast("bigint").alias("version"))


def drift_refresh(entries: DataFrame, history: DataFrame, now, limit: float = 0.1, ttl_scale: int = 1) -> DataFrame:
    """Entries of drifting keys with their lifetime started again at ``now``.

    ``entries`` need ``query_hash``; levels query and embedding are refreshed.
    ``limit`` is a number or a :func:`rule_threshold`.
    """
    ttl = ttl_for(F.col("level"), F.col("ttl_s"), ttl_scale)
    return (
        entries.filter(F.col("level").isin("query", "embedding"))
        .join(drift(history, limit), "query_hash", "left_semi")
        .withColumn("expires_at", F.lit(now) + F.make_dt_interval(secs=ttl))
    )


def age_seconds(ts, now):
    """Seconds since ``ts``; a missing time counts as the epoch."""
    return (micros(F.lit(now)) - F.coalesce(micros(ts), F.lit(0))) / 1e6


def age_warning(entries: DataFrame, now, max_age_s: float = 86_400) -> DataFrame:
    """Entries older than ``max_age_s``, a number or a :func:`rule_threshold`."""
    return entries.withColumn("age_s", age_seconds(F.col("created_at"), now)).filter(F.col("age_s") > max_age_s)


def mark_stale(
    entries: DataFrame, last_access: DataFrame, now, max_age_s: float = 86_400, max_idle_s: float = 3_600
) -> DataFrame:
    """Entries with ``stale``: old and not accessed lately; never accessed is idle."""
    joined = entries.join(last_access.select("key", "last_access"), "key", "left")
    old = age_seconds(F.col("created_at"), now) > max_age_s
    idle = age_seconds(F.col("last_access"), now) > max_idle_s
    return joined.withColumn("stale", old & idle)


def stale_share(marked: DataFrame, limit: float = 5.0) -> DataFrame:
    counts = marked.agg(F.count(F.lit(1)).alias("total_entries_checked"), F.count_if("stale").alias("stale_entries"))
    share = percent(F.col("stale_entries"), F.col("total_entries_checked"))
    return counts.select(
        "*", F.round(share, 4).alias("stale_percentage"),
        (share > limit).alias("cleanup_due"), (share <= limit).alias("goal_achieved"),
    )


def clean_stale(marked: DataFrame, limit: float = 5.0) -> DataFrame:
    """Drops stale entries, but only if they are more than ``limit`` percent."""
    due = stale_share(marked, limit).select("cleanup_due").scalar()
    return marked.filter(~(F.col("stale") & due))


def invalidation_stats(actions: DataFrame, drifted: DataFrame, share: DataFrame) -> DataFrame:
    """One row from the outcome of all checks; every input here is aggregated to one row."""
    acts = actions.agg(
        F.count(F.lit(1)).alias("total_invalidations"),
        F.count_if(F.col("rule_type") == "model_version").alias("model_version_changes"),
        F.count_if(F.col("rule_type") == "corpus_change").alias("corpus_changes"),
    )
    drifts = drifted.agg(F.count(F.lit(1)).alias("semantic_drift_detected"))
    stale = share.select("stale_entries", "stale_percentage", "total_entries_checked", "goal_achieved")
    return beside(acts, drifts, stale)
