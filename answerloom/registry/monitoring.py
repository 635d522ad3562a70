"""Statistics, history, alerts, rules and recommendations."""

from pyspark.sql import functions as F

from ..operators import monitor as mo, rules as ru, similarity as sm, warming as wa
from ..plans import digests
from ..session import beside
from . import query
from .similarity import _DRIFT, history as vector_history
from .views import (
    ALERTS, ENTRIES, HISTORY, LOG, NOW, SLOW_ALERTS, access_log, counted, documents, entries, events, metrics_history, now,
    slow_alerts, table, us,
)

LIMIT = 8_000
MB = "1048576.0::DOUBLE"


@query("entries_by_level", f"""WITH {ENTRIES}, l AS (SELECT unnest(['query', 'embedding', 'context', 'result']) AS level)
SELECT l.level, count(e.key) AS entries FROM l LEFT JOIN entries e USING (level) GROUP BY 1
UNION ALL SELECT 'all', count(*) FROM entries""")
def entries_by_level(spark, sf):
    return mo.entries_by_level(entries(spark, sf))


@query("memory_by_level", f"""WITH {ENTRIES}, l AS (SELECT unnest(['query', 'embedding', 'context', 'result']) AS level),
b AS (SELECT l.level, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM l LEFT JOIN entries e USING (level) GROUP BY 1)
SELECT level, bytes, round(bytes / {MB}, 2) AS mb, round(100.0::DOUBLE * bytes / {LIMIT}, 2) AS percentage FROM b""")
def memory_by_level(spark, sf):
    return mo.memory_by_level(entries(spark, sf), LIMIT)


@query("memory_pressure", f"""WITH {ENTRIES}, t AS (SELECT coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes FROM entries)
SELECT total_bytes, round(total_bytes / {MB}, 2) AS total_mb, round(total_bytes / ({MB} * 1024), 3) AS total_gb,
  round(100.0::DOUBLE * total_bytes / {LIMIT}, 2) AS usage_percentage,
  CASE WHEN total_bytes = 0 OR total_bytes / {LIMIT}.0::DOUBLE < 0.5 THEN 'low' WHEN total_bytes / {LIMIT}.0::DOUBLE < 0.8 THEN 'medium'
    WHEN total_bytes / {LIMIT}.0::DOUBLE < 0.95 THEN 'high' ELSE 'critical' END AS memory_pressure,
  CASE WHEN total_bytes > 104857600 THEN 'high' WHEN total_bytes > 52428800 THEN 'medium' ELSE 'low' END AS absolute_pressure FROM t""")
def memory_pressure(spark, sf):
    return mo.memory_usage(entries(spark, sf), LIMIT)


@query("level_info", f"""WITH {ENTRIES} SELECT level, key, count(*) OVER (PARTITION BY level) AS entry_count,
  (sum(size_bytes) OVER (PARTITION BY level))::BIGINT AS memory_usage_bytes,
  round(sum(size_bytes) OVER (PARTITION BY level) / {MB}, 2) AS memory_usage_mb FROM entries""")
def level_info(spark, sf):
    return mo.level_info(entries(spark, sf))


_WINDOW = """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS ts, count(*) FILTER (op IN ('view', 'click')) AS hits,
  count(*) FILTER (op = 'error') AS misses, count(*) FILTER (op IN ('signup', 'purchase')) AS sets,
  round(sum(value), 2) AS memory, count(*) AS operations FROM log GROUP BY 1"""


@query("metrics_window", f"""WITH {LOG}, w AS ({_WINDOW})
SELECT *, CASE WHEN hits + misses = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * hits / (hits + misses), 2) END AS cache_hit_rate FROM w""")
def metrics_window(spark, sf):
    out = mo.metrics_window(counted(access_log(spark, sf)), "1 hour")
    return out.withColumns(dict(zip(("ts",), us("ts"))))


@query("history_tail", f"WITH {HISTORY} SELECT epoch_us(ts) AS ts, hits, misses, cache_hit_rate FROM history ORDER BY ts DESC LIMIT 100")
def history_tail(spark, sf):
    return mo.history_tail(metrics_history(spark, sf), 100).select(*us("ts"), "hits", "misses", "cache_hit_rate")


_TREND = """t AS (SELECT row_number() OVER (ORDER BY ts DESC) AS rn, cache_hit_rate AS r, memory AS m, ts FROM history),
ends AS (SELECT count(*) FILTER (rn <= 20) AS n, coalesce(sum(r) FILTER (rn <= 10), 0) / 10 AS recent,
  coalesce(sum(r) FILTER (rn BETWEEN 11 AND 20), 0) / 10 AS older, coalesce(sum(m) FILTER (rn <= 10), 0) / 10 AS m_recent,
  coalesce(sum(m) FILTER (rn BETWEEN 11 AND 20), 0) / 10 AS m_older, arg_max(m, ts) AS current_memory FROM t)"""


@query("hit_rate_trend", f"""WITH {HISTORY}, {_TREND}
SELECT round(CASE WHEN n >= 10 THEN recent - older ELSE 0 END, 6) AS hit_rate_trend FROM ends""")
def hit_rate_trend(spark, sf):
    return mo.hit_rate_trend(metrics_history(spark, sf))


@query("memory_growth", f"""WITH {HISTORY}, {_TREND} SELECT current_memory * 100000 AS current_memory,
  round(CASE WHEN n >= 10 AND m_older > 0 THEN (m_recent - m_older) / m_older ELSE 0 END, 6) AS memory_growth_rate,
  CASE WHEN current_memory * 100000 > 104857600 THEN 'high' WHEN current_memory * 100000 > 52428800 THEN 'medium' ELSE 'low' END AS pressure,
  concat_ws('; ', CASE WHEN current_memory * 100000 > 104857600 THEN 'Consider reducing cache size' END,
    CASE WHEN current_memory * 100000 > 104857600 THEN 'Implement more aggressive eviction policy' END,
    CASE WHEN current_memory * 100000 > 52428800 THEN 'Monitor memory usage closely' END) AS advice FROM ends""")
def memory_growth(spark, sf):
    return mo.memory_growth(metrics_history(spark, sf).withColumn("memory", F.col("memory") * 100_000))


@query("alerts_raw", f"WITH {ALERTS} SELECT epoch_us(ts) AS ts, level, category, message FROM alerts")
def alerts_raw(spark, sf):
    return mo.threshold_alerts(metrics_history(spark, sf)).select(*us("ts"), "level", "category", "message")


@query("alert_cooldown", f"""WITH RECURSIVE {SLOW_ALERTS}, s AS (SELECT level, category, message, seq, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY level, category, message ORDER BY ts, seq) AS rn FROM raw),
f AS (SELECT level, category, message, seq, t, rn, t AS last, true AS emitted FROM s WHERE rn = 1
  UNION ALL SELECT s.level, s.category, s.message, s.seq, s.t, s.rn, CASE WHEN s.t - f.last >= 21600000000 THEN s.t ELSE f.last END,
    s.t - f.last >= 21600000000 FROM f JOIN s ON s.level = f.level AND s.message = f.message AND s.rn = f.rn + 1)
SELECT t AS ts, level, category, message, seq FROM f WHERE emitted""")
def alert_cooldown(spark, sf):
    out = mo.alert_cooldown(slow_alerts(spark, sf), 6 * 3600, ("ts", "seq"))
    return out.select(*us("ts"), "level", "category", "message", "seq")


@query("alerts_filter", f"""WITH {ALERTS} SELECT epoch_us(ts) AS ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, level, category, message
FROM alerts WHERE ts >= {NOW} - INTERVAL 240 HOUR AND level = 'warning' AND category = 'memory'""")
def alerts_filter(spark, sf):
    raw = mo.threshold_alerts(metrics_history(spark, sf))
    out = mo.alerts_filter(raw, now(spark, sf), "warning", "memory", hours=240)
    return out.select(*us("ts"), "datetime", "level", "category", "message")


@query("recommendations_recent", f"""WITH {HISTORY}, r AS (SELECT * FROM history ORDER BY ts DESC LIMIT 10),
a AS (SELECT count(*) AS n, avg(cache_hit_rate) AS rate, avg(cache_memory_usage) AS memory FROM (
  SELECT cache_hit_rate * 0.6::DOUBLE AS cache_hit_rate, cache_memory_usage * 1.3::DOUBLE AS cache_memory_usage FROM r))
SELECT 'hit_rate' AS type, 'high' AS priority, 'Consider increasing cache size or adjusting TTL values' AS message, round(rate, 6) AS value FROM a WHERE n = 10 AND rate < 50
UNION ALL SELECT 'memory', 'high', 'Consider reducing cache size or implementing more aggressive eviction', round(memory, 6) FROM a WHERE n = 10 AND memory > 80""")
def recommendations_recent(spark, sf):
    # A worse history than the given one, so that there is something to advise.
    worse = metrics_history(spark, sf).withColumns({
        "cache_hit_rate": F.col("cache_hit_rate") * 0.6, "cache_memory_usage": F.col("cache_memory_usage") * 1.3,
    })
    return mo.recommendations_recent(worse)


@query("performance_summary", f"""WITH {ALERTS}, {_TREND}, h AS (SELECT * FROM history),
l AS (SELECT max(ts) AS last_ts, min(ts) AS first_ts, arg_max(cache_hit_rate, ts) AS cache_hit_rate, arg_max(cache_memory_usage, ts) AS cache_memory_usage,
  arg_max(hits, ts) AS hits, arg_max(misses, ts) AS misses, arg_max(sets, ts) AS sets, arg_max(memory, ts) AS memory,
  arg_max(cache_total_entries, ts) AS cache_total_entries FROM h),
a AS (SELECT ts FROM alerts)
SELECT epoch_us(last_ts) AS last_ts, cache_hit_rate, cache_memory_usage, hits, misses, sets, memory, cache_total_entries,
  round((epoch_us({NOW}) - epoch_us(first_ts)) / 1e6::DOUBLE, 6) AS monitoring_duration,
  concat_ws('; ', CASE WHEN cache_memory_usage > 80 THEN 'High memory usage detected' END, CASE WHEN cache_hit_rate < 50 THEN 'Low hit rate detected' END) AS recommendations,
  (SELECT round(CASE WHEN n >= 10 THEN recent - older ELSE 0 END, 6) FROM ends) AS hit_rate_trend,
  (SELECT count(*) FROM a) AS total_alerts, (SELECT count(*) FROM a WHERE epoch_us({NOW}) - epoch_us(ts) < 3600000000) AS recent_alerts FROM l""")
def performance_summary(spark, sf):
    history = metrics_history(spark, sf)
    out = mo.performance_summary(history, mo.threshold_alerts(history), now(spark, sf))
    return out.withColumns({
        "monitoring_duration": F.round("monitoring_duration", 6), "last_ts": us("last_ts")[0],
    })


@query("current_recommendations", f"""WITH {HISTORY}, l AS (SELECT arg_max(cache_hit_rate, ts) * 0.6::DOUBLE AS rate, arg_max(cache_memory_usage, ts) * 1.8::DOUBLE AS memory FROM history)
SELECT 'memory_optimization' AS type, 'high' AS priority, 'High memory usage detected' AS message,
  'Consider reducing cache size or implementing more aggressive eviction' AS action FROM l WHERE memory > 80
UNION ALL SELECT 'hit_rate_optimization', 'medium', 'Low hit rate detected', 'Consider increasing cache size or adjusting TTL values' FROM l WHERE rate < 50""")
def current_recommendations(spark, sf):
    # A worse history than the given one, so that there is something to advise.
    return mo.current_recommendations(metrics_history(spark, sf).withColumns({
        "cache_hit_rate": F.col("cache_hit_rate") * 0.6, "cache_memory_usage": F.col("cache_memory_usage") * 1.8,
    }))


@query("monitoring_stats", f"""WITH {ALERTS} SELECT (SELECT count(*) FROM history) AS performance_history_size,
  epoch_us((SELECT max(ts) FROM history)) AS last_monitoring, (SELECT count(*) FROM alerts) AS total_alerts""")
def monitoring_stats(spark, sf):
    history = metrics_history(spark, sf)
    out = mo.monitoring_stats(history, mo.threshold_alerts(history))
    return out.withColumn("last_monitoring", us("last_monitoring")[0])


# ------------------------------------------------------------------- rules

_MARKED = """marked AS (SELECT *, epoch_us({now}) - epoch_us(created_at) > 86400000000
  AND epoch_us({now}) - coalesce(epoch_us(seen), 0) > 3600000000 AS stale FROM (
    SELECT e.*, s.seen FROM entries e LEFT JOIN (SELECT key, max(ts) AS seen FROM log GROUP BY 1) s USING (key)))""".format(now=NOW)
_LOG_ONLY = LOG.split(", log AS", 1)[1]
STALE = f"{ENTRIES}, log AS{_LOG_ONLY}, {_MARKED}"


def marked(spark, sf):
    seen = access_log(spark, sf).groupBy("key").agg(F.max("ts").alias("last_access"))
    return ru.mark_stale(entries(spark, sf).drop("last_access"), seen, now(spark, sf))


@query("stale_entries", f"WITH {STALE} SELECT key, level, stale FROM marked")
def stale_entries(spark, sf):
    return marked(spark, sf).select("key", "level", "stale")


_SHARE = """share AS (SELECT count(*) AS total_entries_checked, count(*) FILTER (stale) AS stale_entries,
  round(100.0::DOUBLE * count(*) FILTER (stale) / count(*), 4) AS stale_percentage,
  100.0::DOUBLE * count(*) FILTER (stale) / count(*) > 5 AS cleanup_due, 100.0::DOUBLE * count(*) FILTER (stale) / count(*) <= 5 AS goal_achieved FROM marked)"""


@query("stale_share", f"WITH {STALE}, {_SHARE} SELECT * FROM share")
def stale_share(spark, sf):
    return ru.stale_share(marked(spark, sf))


@query("stale_cleanup", f"WITH {STALE}, {_SHARE} SELECT key, level FROM marked WHERE NOT (stale AND (SELECT cleanup_due FROM share))")
def stale_cleanup(spark, sf):
    return ru.clean_stale(marked(spark, sf)).select("key", "level")


_VERSIONS = """corpus AS (SELECT (sum(('0x' || substr(md5(text), 1, 15))::BIGINT) % 2305843009213693951)::VARCHAR AS v,
  (coalesce(sum(('0x' || substr(md5(text), 1, 15))::BIGINT) FILTER (lang = 'en'), 0) % 2305843009213693951)::VARCHAR AS v_en FROM documents),
model AS (SELECT count(DISTINCT label) AS n FROM embeddings),
versions AS (SELECT 'corpus' AS kind, 'context' AS level, v_en AS stored, v AS current FROM corpus
  UNION ALL SELECT 'corpus', 'query', v, v FROM corpus
  UNION ALL SELECT 'model', 'result', (n - 1)::VARCHAR, n::VARCHAR FROM model
  UNION ALL SELECT 'model', 'query', n::VARCHAR, n::VARCHAR FROM model),
changed AS (SELECT CASE kind WHEN 'model' THEN 'model_version' ELSE 'corpus_change' END AS rule_type, level FROM versions WHERE stored IS DISTINCT FROM current)"""


def versions(spark, sf):
    """Versions worked out from the documents and vectors; two of four have changed."""
    docs = documents(spark, sf)
    v = ru.corpus_version(docs).select(F.col("version").cast("string").alias("v"))
    en = ru.corpus_version(docs.filter("lang = 'en'")).select(F.col("version").cast("string").alias("v_en"))
    n = table(spark, sf, "embeddings").agg(F.count_distinct("label").alias("n"))
    row = beside(v, en, n)
    s = F.col("n").cast("string")

    def version(kind, level, stored, current):
        return F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), stored.alias("stored"), current.alias("current"))

    all_rows = F.array(
        version("corpus", "context", F.col("v_en"), F.col("v")), version("corpus", "query", F.col("v"), F.col("v")),
        version("model", "result", (F.col("n") - 1).cast("string"), s), version("model", "query", s, s),
    )
    return row.select(F.explode(all_rows).alias("r")).select("r.*")


def actions(spark, sf):
    return ru.apply_rules(ru.changed_versions(versions(spark, sf)), ru.default_rules(spark))


@query("version_invalidate", f"""WITH {ENTRIES}, {_VERSIONS}
SELECT key, level FROM entries WHERE (level = 'result' AND EXISTS (SELECT 1 FROM changed WHERE rule_type = 'model_version' AND level = 'result'))
  OR (level = 'context' AND EXISTS (SELECT 1 FROM changed WHERE rule_type = 'corpus_change' AND level = 'context'))""")
def version_invalidate(spark, sf):
    return ru.invalidated(entries(spark, sf), actions(spark, sf)).select("key", "level")


@query("corpus_changes", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0
  UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 29 = 0)
SELECT coalesce(a.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents d FULL JOIN a ON a.doc_id = d.doc_id WHERE a.text IS DISTINCT FROM d.text""")
def corpus_changes(spark, sf):
    """Documents that differ between the corpus and an edited one, from kept digest trees."""
    docs = documents(spark, sf).select("doc_id", "text")
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    edited = docs.filter("doc_id % 17 <> 0").withColumn("text", text).unionByName(
        docs.filter("doc_id % 29 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    levels = digests.levels_for(docs.count())
    trees = digests.digest_tree(docs, levels), digests.digest_tree(edited, levels)
    return digests.changed_documents(docs, edited, levels=levels, trees=trees)


@query("corpus_version", """SELECT (sum(('0x' || substr(md5(text), 1, 15))::BIGINT) % 2305843009213693951)::BIGINT AS version FROM documents""")
def corpus_version(spark, sf):
    return ru.corpus_version(documents(spark, sf))


@query("drift_refresh", f"""WITH {ENTRIES}, {_DRIFT}
SELECT key, level, epoch_us({NOW} + to_seconds(ttl_s)) AS expires_at FROM entries
WHERE level IN ('query', 'embedding') AND (key::INT % 20)::VARCHAR IN (SELECT query_hash FROM drift WHERE drift > 0.1)""")
def drift_refresh(spark, sf):
    e = entries(spark, sf).withColumn("query_hash", (F.col("key").cast("int") % 20).cast("string"))
    out = ru.drift_refresh(e, vector_history(spark, sf), now(spark, sf), ru.rule_threshold(ru.default_rules(spark), "semantic_drift"))
    return out.select("key", "level", *us("expires_at"))


@query("age_warning", f"""WITH {ENTRIES}, a AS (SELECT key, level, (epoch_us({NOW}) - epoch_us(created_at)) / 1e6::DOUBLE AS age_s FROM entries)
SELECT key, level, round(age_s, 6) AS age_s FROM a WHERE age_s > 86400""")
def age_warning(spark, sf):
    return ru.age_warning(entries(spark, sf), now(spark, sf), ru.rule_threshold(ru.default_rules(spark), "time_based")).select("key", "level", F.round("age_s", 6).alias("age_s"))


_RULES = """rules AS (SELECT * FROM (VALUES ('model_version', 'invalidate', ['result', 'generation'], 'Invalidate when model version changes'),
  ('corpus_change', 'invalidate', ['context', 'retrieval'], 'Invalidate when corpus changes'),
  ('semantic_drift', 'refresh', ['query', 'embedding'], 'Refresh when semantic drift detected'),
  ('time_based', 'warn', ['all'], 'Warn about old entries')) r(rule_type, action, affected, description))"""


@query("apply_rules", f"""WITH {ENTRIES}, {_RULES}, t AS (SELECT DISTINCT level,
  CASE key::INT % 4 WHEN 0 THEN 'model_version' WHEN 1 THEN 'corpus_change' WHEN 2 THEN 'semantic_drift' ELSE 'time_based' END AS rule_type FROM entries)
SELECT t.rule_type, t.level, r.action, r.description FROM t JOIN rules r USING (rule_type)
WHERE list_contains(r.affected, t.level) OR list_contains(r.affected, 'all')""")
def apply_rules(spark, sf):
    kinds = F.array(*map(F.lit, ("model_version", "corpus_change", "semantic_drift", "time_based")))
    rule = F.element_at(kinds, F.col("key").cast("int") % 4 + 1)
    triggers = entries(spark, sf).select(rule.alias("rule_type"), "level").distinct()
    return ru.apply_rules(triggers, ru.default_rules(spark))


@query("invalidation_stats", f"""WITH {STALE}, {_SHARE}, {_VERSIONS}, {_DRIFT},
acts AS (SELECT * FROM changed WHERE (rule_type = 'model_version' AND level = 'result') OR (rule_type = 'corpus_change' AND level = 'context'))
SELECT (SELECT count(*) FROM acts) AS total_invalidations, (SELECT count(*) FROM acts WHERE rule_type = 'model_version') AS model_version_changes,
  (SELECT count(*) FROM acts WHERE rule_type = 'corpus_change') AS corpus_changes, (SELECT count(*) FROM drift WHERE drift > 0.1) AS semantic_drift_detected,
  stale_entries, stale_percentage, total_entries_checked, goal_achieved FROM share""")
def invalidation_stats(spark, sf):
    return ru.invalidation_stats(
        actions(spark, sf), sm.drift(vector_history(spark, sf)), ru.stale_share(marked(spark, sf))
    )


# ----------------------------------------------------------------- warming

POPULAR = f"""WITH {LOG}, c AS (SELECT key, count(*) AS access_count, max(ts) AS last_access, min((ts, seq)) AS first FROM log GROUP BY 1),
top AS (SELECT * FROM c ORDER BY access_count DESC, first LIMIT 10)
SELECT key, access_count, epoch_us(last_access) AS last_access,
  (SELECT count(*) FROM log WHERE log.key = top.key AND epoch_us(log.ts) > epoch_us(top.last_access) - 86400000000) AS recent_accesses FROM top"""


@query("popular_items", POPULAR)
def popular_items(spark, sf):
    return wa.popular_items(access_log(spark, sf)).select("key", "access_count", *us("last_access"), "recent_accesses")


def _asked(spark, sf):
    return events(spark, sf).select(F.concat_ws("-", "k", "event_type").alias("query"), "ts", F.col("event_id").alias("seq"))


@query("frequent_queries", f"""WITH {ENTRIES}, c AS (SELECT k || '-' || event_type AS query, count(*) AS frequency, min((ts, event_id)) AS first FROM ev GROUP BY 1),
top AS (SELECT * FROM c ORDER BY frequency DESC, first LIMIT 10)
SELECT query, frequency, EXISTS (SELECT 1 FROM entries e WHERE e.level = 'result' AND e.key || '-click' = query AND NOT ({NOW} > e.expires_at)) AS cached FROM top""")
def frequent_queries(spark, sf):
    held = entries(spark, sf).withColumn("key", F.concat("key", F.lit("-click")))
    return wa.frequent_queries(_asked(spark, sf), held, now(spark, sf))


_FIRST = """first AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key
  ORDER BY list_position(['query', 'embedding', 'context', 'result'], level)) = 1)"""


@query("warming_recommendations", f"""WITH {ENTRIES}, {_FIRST},
i AS (SELECT CASE WHEN k::INT % 8 < 4 THEN 'item ' ELSE '' END || k::INT % 8 AS key, count(*) AS n FROM ev GROUP BY 1),
j AS (SELECT 'key ' || (k::INT % 15) AS key, count(*) AS n FROM ev GROUP BY 1)
SELECT 'popular_item' AS type, 'high' AS priority, 'Item "' || key || '" is frequently accessed but not cached' AS message,
  'Consider pre-loading item "' || key || '"' AS action FROM i
WHERE n > (SELECT sum(n) FROM i) * 0.1 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.key = i.key AND NOT ({NOW} > f.expires_at))
UNION ALL SELECT 'frequent_query', 'medium', 'Query "' || key || '..." is frequent but not cached',
  'Consider pre-computing result for "' || key || '..."' FROM j
WHERE n > (SELECT sum(n) FROM j) * 0.05 AND NOT EXISTS (SELECT 1 FROM entries e WHERE 'key ' || e.key = j.key AND e.level = 'result' AND NOT ({NOW} > e.expires_at))""")
def warming_recommendations(spark, sf):
    e, k = entries(spark, sf), F.col("k").cast("int")
    ev = events(spark, sf)
    # Eight items and fifteen queries share all accesses; half of the items were never stored.
    prefix = F.when(k % 8 < 4, "item ").otherwise("")
    log = ev.select(F.concat(prefix, (k % 8).cast("string")).alias("key"))
    asked = ev.select(F.concat(F.lit("key "), (k % 15).cast("string")).alias("query"))
    named = e.withColumn("key", F.concat(F.lit("key "), "key"))
    # One table with both spellings: the item check reads one, the query check the other.
    return wa.warming_recommendations(log, asked, e.unionByName(named), now(spark, sf))


@query("strategies_due", f"""WITH {LOG}, s AS (SELECT op AS name, max(ts) AS last_run, count(*) % 2 = 0 OR op = 'view' AS enabled, (count(*) % 900)::INT AS frequency FROM log GROUP BY 1)
SELECT name, frequency FROM s WHERE enabled AND (epoch_us({NOW}) - epoch_us(last_run)) / 1e6::DOUBLE >= frequency""")
def strategies_due(spark, sf):
    n = F.count(F.lit(1))
    s = access_log(spark, sf).groupBy(F.col("op").alias("name")).agg(
        F.max("ts").alias("last_run"), ((n % 2 == 0) | (F.first("op") == "view")).alias("enabled"), (n % 900).cast("int").alias("frequency")
    )
    return wa.strategies_due(s, now(spark, sf)).select("name", "frequency")


@query("warming_stats", f"""WITH {LOG} SELECT count(DISTINCT key) AS access_patterns_tracked, count(*) AS accesses, epoch_us(max(ts)) AS last_access,
  (SELECT count(DISTINCT text) FROM conversations WHERE role = 'user') AS query_patterns_tracked,
  (SELECT count(DISTINCT event_type) FROM events) AS strategies_run, (SELECT count(*) FROM events WHERE event_type <> 'error') AS successful_warmings,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_warmings FROM log""")
def warming_stats(spark, sf):
    kind = F.col("event_type")
    runs = events(spark, sf).select(kind.alias("name"), (kind != "error").alias("ok"))
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(F.col("text").alias("query"))
    return wa.warming_stats(access_log(spark, sf), asked, runs).withColumn("last_access", us("last_access")[0])
