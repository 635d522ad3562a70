"""Statistics, metric history, alerts and recommendations.

``history``: (ts, cache_hit_rate, cache_memory_usage, cache_total_entries,
hits, misses, sets, deletes), one row per sampling period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.entries import (
    absolute_pressure, micros, percent, pressure,
)
from ..schemas import LEVELS
from ..session import beside
from .lifecycle import spaced_rows

MIB = 1024 * 1024

# Alert thresholds as shares.
MEMORY_WARNING, MEMORY_CRITICAL, HIT_RATE_LOW, SYSTEM_MEMORY_HIGH = 0.8, 0.95, 0.3, 0.9
ALERT_COOLDOWN_S = 300
HISTORY_SIZE, ALERT_SIZE = 1000, 100

# Alert texts.
MEMORY_CRITICAL_TEXT = "Cache memory usage critical: "
MEMORY_WARNING_TEXT = "Cache memory usage high: "
HIT_RATE_TEXT = "Cache hit rate low: "
SYSTEM_MEMORY_TEXT = "System memory usage critical: "

# Recommendation texts.
GROW_CACHE = "Consider increasing cache size or adjusting TTL values"
SHRINK_CACHE = "Consider reducing cache size or implementing more aggressive eviction"
CURRENT_MEMORY = ("memory_optimization", "high", "High memory usage detected", SHRINK_CACHE)
CURRENT_HIT_RATE = ("hit_rate_optimization", "medium", "Low hit rate detected", GROW_CACHE)
MEMORY_ADVICE = (
    "Consider reducing cache size", "Implement more aggressive eviction policy", "Monitor memory usage closely",
)


def _levels(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LEVELS], "level string")


# ------------------------------------------------------------ statistics

def hit_stats(outcomes: DataFrame) -> DataFrame:
    """One row from lookups (ts, source exact/semantic/miss, dead_match).

    ``hit_rate`` counts requests. ``hit_rate_reference`` counts the inner
    probes too: a semantic hit is a miss and two hits, a miss with a dead best
    match two misses.
    """
    s = F.col("source")
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(s == "exact").alias("exact_hits"),
        F.count_if(s == "semantic").alias("semantic_hits"),
        F.count_if(s == "miss").alias("misses"),
        F.count_if((s == "miss") & F.col("dead_match")).alias("dead_matches"),
        F.min("ts").alias("oldest_access"), F.max("ts").alias("newest_access"),
    )
    hits = F.col("exact_hits") + F.col("semantic_hits")
    twice = F.col("exact_hits") + 2 * F.col("semantic_hits")
    probes = twice + F.col("semantic_hits") + F.col("misses") + F.col("dead_matches")
    return counts.withColumns({
        "hit_rate": percent(hits, F.col("requests"), 2),
        "hit_rate_reference": percent(twice, probes, 2),
    })


def entries_by_level(entries: DataFrame) -> DataFrame:
    """Rows per level (zeros listed) and the total as level ``all``."""
    counts = entries.filter(F.col("level").isin(*LEVELS)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    per_level = _levels(entries.sparkSession).join(counts, "level", "left").select(
        "level", F.coalesce("n", F.lit(0)).alias("n")
    )
    return (
        per_level.rollup("level").agg(F.sum("n").alias("entries"))
        .select(F.coalesce("level", F.lit("all")).alias("level"), "entries")
    )


def memory_by_level(entries: DataFrame, limit_bytes: int) -> DataFrame:
    sizes = entries.groupBy("level").agg(F.sum("size_bytes").alias("b"))
    used = _levels(entries.sparkSession).join(sizes, "level", "left").select(
        "level", F.coalesce("b", F.lit(0)).cast("bigint").alias("bytes")
    )
    return used.withColumns({
        "mb": F.round(F.col("bytes") / MIB, 2),
        "percentage": percent(F.col("bytes"), F.lit(limit_bytes), 2),
    })


def memory_usage(entries: DataFrame, limit_bytes: int) -> DataFrame:
    """One row: totals against the limit and both pressure scales."""
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"))
    used = F.col("total_bytes")
    return total.withColumns({
        "total_mb": F.round(used / MIB, 2),
        "total_gb": F.round(used / (MIB * 1024), 3),
        "usage_percentage": percent(used, F.lit(limit_bytes), 2),
        "memory_pressure": pressure(used, F.lit(limit_bytes)),
        "absolute_pressure": absolute_pressure(used),
    })


def level_info(entries: DataFrame) -> DataFrame:
    """Each key of a level beside the level's totals (one row per key, no key lists).

    At most one totals row per level, so the totals are broadcast.
    """
    kept = entries.filter(F.col("level").isin(*LEVELS))
    totals = kept.groupBy("level").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum("size_bytes").alias("memory_usage_bytes")
    ).withColumn("memory_usage_mb", F.round(F.col("memory_usage_bytes") / MIB, 2))
    return kept.select("level", "key").join(F.broadcast(totals), "level")


def metrics_window(log: DataFrame, duration: str = "30 seconds") -> DataFrame:
    """Metric history from a log with booleans ``is_hit``, ``is_miss``, ``is_set`` and ``value``; also fits a stream."""
    return (
        log.groupBy(F.window("ts", duration).alias("w"))
        .agg(
            F.count_if("is_hit").alias("hits"), F.count_if("is_miss").alias("misses"), F.count_if("is_set").alias("sets"),
            F.round(F.sum("value"), 2).alias("memory"), F.count(F.lit(1)).alias("operations"),
        )
        .select(F.col("w.start").alias("ts"), "hits", "misses", "sets", "memory", "operations")
        .withColumn("cache_hit_rate", percent(F.col("hits"), F.col("hits") + F.col("misses"), 2))
    )


# --------------------------------------------------------------- history

def history_tail(history: DataFrame, n: int | None = HISTORY_SIZE) -> DataFrame:
    """The ``n`` latest rows; a bounded top-n, not a window over everything. None: all rows."""
    return history if n is None else history.orderBy(F.col("ts").desc()).limit(n)


def _recent_and_older(history: DataFrame, value: str, true_mean: bool = False) -> DataFrame:
    """Means over the last ten rows and the ten before.

    Divided by ten even where the older slice has fewer rows, unless ``true_mean``.
    """
    def mean(rows):
        total = F.coalesce(F.sum(F.when(rows, F.col(value))), F.lit(0.0))
        return F.coalesce(F.try_divide(total, F.count_if(rows)), F.lit(0.0)) if true_mean else total / 10

    # Twenty rows, so a window without partitions is harmless.
    numbered = history_tail(history.select("ts", value), 20).withColumn(
        "rn", F.row_number().over(Window.orderBy(F.col("ts").desc()))
    )
    return numbered.agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("rn") <= 10).alias("recent"), mean(F.col("rn") > 10).alias("older"),
    )


def hit_rate_trend(history: DataFrame, true_mean: bool = False) -> DataFrame:
    trend = F.when(F.col("n") >= 10, F.col("recent") - F.col("older")).otherwise(0.0)
    return _recent_and_older(history, "cache_hit_rate", true_mean).select(F.round(trend, 6).alias("hit_rate_trend"))


def memory_growth(history: DataFrame, value: str = "memory", true_mean: bool = False) -> DataFrame:
    """Latest memory, growth against the ten samples before, pressure and advice."""
    rate = F.when((F.col("n") >= 10) & (F.col("older") > 0), (F.col("recent") - F.col("older")) / F.col("older"))
    growth = _recent_and_older(history, value, true_mean).select(
        F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("memory_growth_rate")
    )
    latest = history.agg(F.max_by(value, "ts").alias("current_memory")).filter("current_memory is not null")
    now = F.col("current_memory")
    # Plain texts joined with "; " keep the row flat.
    advice = F.concat_ws(
        "; ",
        F.when(now > 100 * MIB, MEMORY_ADVICE[0]), F.when(now > 100 * MIB, MEMORY_ADVICE[1]),
        F.when(now > 50 * MIB, MEMORY_ADVICE[2]),
    )
    return beside(latest.withColumns({"pressure": absolute_pressure(now), "advice": advice}), growth)


# ---------------------------------------------------------------- alerts

def _share_text(percentage):
    return F.concat(F.round(percentage, 1).cast("string"), F.lit("%"))


def threshold_alerts(history: DataFrame, system_memory: str | None = None) -> DataFrame:
    """Raw alerts (ts, level, category, message, details) each sample gives rise to.

    ``details`` has the value and the threshold it was held against, in percent.
    """
    memory, rate = F.col("cache_memory_usage"), F.col("cache_hit_rate")

    def alert(level, category, text, value, threshold):
        return F.struct(
            F.lit(level).alias("level"), F.lit(category).alias("category"),
            F.concat(F.lit(text), _share_text(value)).alias("message"),
            F.create_map(
                F.lit("value"), F.round(value, 6).cast("string"), F.lit("threshold"), F.lit(str(100 * threshold)),
            ).alias("details"),
        )

    found = [
        F.when(memory / 100 >= MEMORY_CRITICAL, alert("critical", "memory", MEMORY_CRITICAL_TEXT, memory, MEMORY_CRITICAL))
        .when(memory / 100 >= MEMORY_WARNING, alert("warning", "memory", MEMORY_WARNING_TEXT, memory, MEMORY_WARNING)),
        F.when(rate / 100 < HIT_RATE_LOW, alert("warning", "performance", HIT_RATE_TEXT, rate, HIT_RATE_LOW)),
    ]
    if system_memory:
        used = F.col(system_memory)
        found.append(
            F.when(used / 100 >= SYSTEM_MEMORY_HIGH, alert("critical", "memory", SYSTEM_MEMORY_TEXT, used, SYSTEM_MEMORY_HIGH))
        )
    return history.select("ts", F.explode(F.filter(F.array(*found), lambda a: a.isNotNull())).alias("a")).select("ts", "a.*")


def alert_cooldown(raw: DataFrame, cooldown_s: float = ALERT_COOLDOWN_S, order=("ts",), slices=None) -> DataFrame:
    """Alerts that come through: per alert, none within the cooldown of the last one let through."""
    marked = spaced_rows(
        raw, ["level", "category", "message"], list(order), cooldown_s, "emitted", False, slices
    )
    return marked.filter("emitted").drop("emitted")


def alerts_filter(alerts: DataFrame, now, level=None, category=None, hours: float = 24) -> DataFrame:
    cutoff = F.lit(now) - F.make_dt_interval(secs=F.lit(hours * 3600))
    kept = alerts.filter(F.col("ts") >= cutoff)
    if level:
        kept = kept.filter(F.col("level") == level)
    if category:
        kept = kept.filter(F.col("category") == category)
    return kept.withColumn("datetime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------- recommendations

def recommendations_recent(history: DataFrame) -> DataFrame:
    """Advice from the mean of the last ten samples; none from fewer than ten."""
    recent = history_tail(history, 10).agg(
        F.count(F.lit(1)).alias("n"), F.avg("cache_hit_rate").alias("rate"), F.avg("cache_memory_usage").alias("memory")
    )

    def advice(kind, text, value):
        return F.struct(
            F.lit(kind).alias("type"), F.lit("high").alias("priority"), F.lit(text).alias("message"),
            F.round(value, 6).alias("value"),
        )

    found = F.array(
        F.when(F.col("rate") < 50, advice("hit_rate", GROW_CACHE, F.col("rate"))),
        F.when(F.col("memory") > 80, advice("memory", SHRINK_CACHE, F.col("memory"))),
    )
    return recent.filter("n = 10").select(F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select("a.*")


def current_recommendations(history: DataFrame) -> DataFrame:
    """(type, priority, message, action) that the latest sample gives rise to."""
    latest = history.agg(F.max_by(F.struct("cache_hit_rate", "cache_memory_usage"), "ts").alias("m"))

    def advice(kind, priority, message, action):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("type", "priority", "message", "action"), (kind, priority, message, action))])

    found = F.array(
        F.when(F.col("m.cache_memory_usage") > 80, advice(*CURRENT_MEMORY)),
        F.when(F.col("m.cache_hit_rate") < 50, advice(*CURRENT_HIT_RATE)),
    )
    return latest.select(F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select("a.*")


def performance_summary(
    history: DataFrame, alerts: DataFrame, now, keep: int | None = None, keep_alerts: int | None = None,
) -> DataFrame:
    """One row: latest sample whole, trend, alert counts, time covered, advice.

    Counts and the time covered are over all rows given, or over the ``keep``
    latest samples and ``keep_alerts`` latest alerts.
    """
    tail = history_tail(history, keep)
    sample = F.struct(*[c for c in history.columns if c != "ts"])
    latest = tail.agg(F.max_by(sample, "ts").alias("m"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    kept = history_tail(alerts, keep_alerts).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(micros(F.lit(now)) - micros(F.col("ts")) < 3600 * 1_000_000).alias("recent_alerts"),
    )
    advice = F.concat_ws(
        "; ",
        F.when(F.col("m.cache_memory_usage") > 80, CURRENT_MEMORY[2]),
        F.when(F.col("m.cache_hit_rate") < 50, CURRENT_HIT_RATE[2]),
    )
    head = latest.filter("last_ts is not null").select(
        "last_ts", "m.*", ((micros(F.lit(now)) - micros(F.col("first_ts"))) / 1e6).alias("monitoring_duration"),
        advice.alias("recommendations"),
    )
    return beside(head, hit_rate_trend(history), kept)


def monitoring_stats(
    history: DataFrame, alerts: DataFrame, keep: int | None = None, keep_alerts: int | None = None,
) -> DataFrame:
    """Sizes of history and alerts, all rows unless bounds are given."""
    h = history_tail(history, keep).agg(
        F.count(F.lit(1)).alias("performance_history_size"), F.max("ts").alias("last_monitoring")
    )
    a = history_tail(alerts, keep_alerts).agg(F.count(F.lit(1)).alias("total_alerts"))
    return beside(h, a)
