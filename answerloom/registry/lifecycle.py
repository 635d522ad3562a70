"""Lifetimes, recency, retention, reuse distance, replay."""

from pyspark.sql import functions as F

from ..functions.entries import (
    classify_level as classify, level_of_value as of_value, parsed_value, setting_problem, value_bytes, vector_bytes,
)
from ..operators import lifecycle as lc
from ..plans.reuse import reuse_distance as distances
from . import query
from .views import ENTRIES, LOG, NOW, OPS, SPAN, access_log, documents, embeddings, entries, now, op_log, table, us

DAY = 86_400
C = 10


@query("ttl_assign", f"""WITH {OPS}, s AS (SELECT seq, level, ts, CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 77 ELSE ttl END AS ttl_s
  FROM ops WHERE operation = 'set')
SELECT seq, level, ttl_s::INT AS ttl_s, epoch_us(ts + to_seconds(ttl_s)) AS expires_at FROM s""")
def ttl_assign(spark, sf):
    own = F.when(F.col("seq") % 3 == 0, 0).when(F.col("seq") % 3 == 1, 77)
    sets = op_log(spark, sf).filter("operation = 'set'").withColumn("ttl", own).withColumn("created_at", F.col("ts"))
    return lc.assign_ttl(sets).select("seq", "level", "ttl_s", *us("expires_at"))


@query("ttl_status", f"""WITH {ENTRIES} SELECT key, level, coalesce({NOW} > expires_at, false) AS expired FROM entries""")
def ttl_status(spark, sf):
    return lc.ttl_status(entries(spark, sf), now(spark, sf)).select("key", "level", "expired")


@query("ttl_expired_keys", f"WITH {ENTRIES} SELECT key, level FROM entries WHERE {NOW} > expires_at")
def ttl_expired_keys(spark, sf):
    return lc.expired_keys(entries(spark, sf), now(spark, sf)).select("key", "level")


@query("ttl_info", f"""WITH {ENTRIES}, i AS (SELECT *, greatest(0, (epoch_us(expires_at) - epoch_us({NOW})) / 1e6::DOUBLE) AS r FROM entries)
SELECT key, level, epoch_us(expires_at) AS expires_at, ttl_s::INT AS ttl_s, round(r, 6) AS remaining_s, r <= 0 AS is_expired FROM i""")
def ttl_info(spark, sf):
    return lc.ttl_info(entries(spark, sf), now(spark, sf)).select(
        "key", "level", *us("expires_at"), "ttl_s", F.round("remaining_s", 6).alias("remaining_s"), "is_expired"
    )


@query("ttl_stats", f"""WITH {ENTRIES}
SELECT count(*) AS total_keys, count(*) FILTER (NOT {NOW} > expires_at) AS active_keys,
  count(*) FILTER ({NOW} > expires_at) AS expired_keys, round(avg(ttl_s), 2) AS average_ttl FROM entries""")
def ttl_stats(spark, sf):
    return lc.ttl_stats(entries(spark, sf), now(spark, sf))


@query("classify_level", """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) AND length(text) < 1000 THEN 'query'
  WHEN doc_id % 4 = 2 THEN 'embedding' WHEN doc_id % 4 = 3 AND lang = 'en' THEN 'result' ELSE 'context' END AS level FROM documents""")
def classify_level(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("string", "string", "array", "object"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(spark, sf).select(
        "doc_id", classify(kind, F.length("text"), F.col("lang") == "en").alias("level")
    )


@query("level_of_value", """WITH v AS (SELECT event_id AS id, props AS value FROM events UNION ALL SELECT -1 - (conv_id * 4194304 + turn), text FROM conversations)
SELECT id, CASE WHEN NOT json_valid(value) OR json_type(CASE WHEN json_valid(value) THEN value ELSE '0' END) = 'VARCHAR'
    THEN CASE WHEN length(value) < 1000 THEN 'query' ELSE 'context' END
  WHEN json_type(value) = 'ARRAY' THEN 'embedding'
  WHEN json_type(value) = 'OBJECT' AND json_extract(value, '$.answer') IS NOT NULL THEN 'result' ELSE 'context' END AS level FROM v""")
def level_of_value(spark, sf):
    """Stored texts of two kinds: event properties (JSON objects) and conversation turns."""
    props = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value"))
    said = table(spark, sf, "conversations").select((-1 - (F.col("conv_id") * SPAN + F.col("turn"))).alias("id"), F.col("text").alias("value"))
    return props.unionByName(said).select("id", of_value(F.col("value")).alias("level"))


@query("keys_by_level", f"WITH {ENTRIES} SELECT key, level FROM entries WHERE level = 'context'")
def keys_by_level(spark, sf):
    return entries(spark, sf).filter("level = 'context'").select("key", "level")


@query("delete_keys", f"""WITH {ENTRIES} SELECT key, level FROM entries
WHERE NOT (key::INT % 5 = 0) AND NOT (key::INT % 3 = 0 AND level = 'query')""")
def delete_keys(spark, sf):
    e = entries(spark, sf)
    k = F.col("key").cast("int")
    deletes = e.filter(k % 5 == 0).select("key", F.lit(None).cast("string").alias("level")).unionByName(
        e.filter((k % 3 == 0) & (F.col("level") == "query")).select("key", "level")
    )
    return lc.delete_keys(e, deletes).select("key", "level")


@query("memory_admission", f"""WITH {OPS}, s AS (SELECT seq, strlen(key) + strlen(value) AS size_bytes,
  sum(strlen(key) + strlen(value)) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS running FROM ops WHERE operation = 'set')
SELECT seq, size_bytes::BIGINT AS size_bytes, running::BIGINT AS running_bytes, running <= 20000 AS admitted FROM s""")
def memory_admission(spark, sf):
    sizes = op_log(spark, sf).filter("operation = 'set'").withColumn(
        "size_bytes", (F.octet_length("key") + F.octet_length("value")).cast("bigint")
    )
    return lc.memory_admission(sizes, 20_000).select("seq", "size_bytes", "running_bytes", "admitted")


@query("memory_refusal", f"""WITH RECURSIVE {LOG}, s AS (SELECT cache_id, seq, round(value)::BIGINT AS size_bytes,
  row_number() OVER (PARTITION BY cache_id ORDER BY ts, seq) AS rn FROM log),
f AS (SELECT cache_id, seq, rn, CASE WHEN size_bytes <= 1500 THEN size_bytes ELSE 0 END AS used, size_bytes <= 1500 AS admitted FROM s WHERE rn = 1
  UNION ALL SELECT s.cache_id, s.seq, s.rn, CASE WHEN f.used + s.size_bytes <= 1500 OR s.size_bytes <= 0 THEN f.used + greatest(s.size_bytes, 0) ELSE f.used END,
    f.used + s.size_bytes <= 1500 OR s.size_bytes <= 0 FROM f JOIN s ON s.cache_id = f.cache_id AND s.rn = f.rn + 1)
SELECT cache_id, seq, admitted FROM f""")
def memory_refusal(spark, sf):
    sizes = access_log(spark, sf).withColumn("size_bytes", F.round("value").cast("bigint"))
    return lc.memory_refusal(sizes, 1_500).select("cache_id", "seq", "admitted")


@query("access_counts", f"""WITH {LOG} SELECT cache_id, key, count(*) AS access_count,
  epoch_us(min(ts)) AS first_access, epoch_us(max(ts)) AS last_access FROM log GROUP BY 1, 2""")
def access_counts(spark, sf):
    out = lc.access_counts(access_log(spark, sf))
    return out.select("cache_id", "key", "access_count", *us("first_access", "last_access"))


_TOUCHED = LOG + """, touched AS (SELECT cache_id, key, max(ts) AS last_access, arg_max(seq, (ts, seq)) AS last_seq,
  count(*) AS access_count FROM log GROUP BY 1, 2)"""


@query("lru_order", f"""WITH {_TOUCHED} SELECT cache_id, key,
  row_number() OVER (PARTITION BY cache_id ORDER BY last_access, last_seq) AS lru_rank FROM touched""")
def lru_order(spark, sf):
    return lc.lru_order(access_log(spark, sf)).select("cache_id", "key", "lru_rank")


@query("mru_order", f"""WITH {_TOUCHED} SELECT cache_id, key,
  row_number() OVER (PARTITION BY cache_id ORDER BY last_access DESC, last_seq DESC) AS mru_rank FROM touched""")
def mru_order(spark, sf):
    return lc.mru_order(access_log(spark, sf)).select("cache_id", "key", "mru_rank")


@query("lfu_order", f"""WITH {_TOUCHED} SELECT cache_id, key, access_count,
  row_number() OVER (PARTITION BY cache_id ORDER BY access_count, last_access, last_seq) AS lfu_rank FROM touched""")
def lfu_order(spark, sf):
    return lc.lfu_order(access_log(spark, sf)).select("cache_id", "key", "access_count", "lfu_rank")


@query("lru_retained", f"""WITH {_TOUCHED} SELECT cache_id, key, epoch_us(last_access) AS last_access FROM touched
QUALIFY row_number() OVER (PARTITION BY cache_id ORDER BY last_access DESC, last_seq DESC) <= {C - 1}""")
def lru_retained(spark, sf):
    return lc.lru_retained(access_log(spark, sf), C).select("cache_id", "key", *us("last_access"))


@query("lru_evicted", f"""WITH {_TOUCHED} SELECT cache_id, key, row_number() OVER (PARTITION BY cache_id ORDER BY last_access, last_seq)::INT AS lru_rank
FROM touched QUALIFY lru_rank <= least(10, count(*) OVER (PARTITION BY cache_id) - {C} + 1)""")
def lru_evicted(spark, sf):
    return lc.lru_evicted(access_log(spark, sf), C).select("cache_id", "key", "lru_rank")


@query("lru_sample", f"""WITH {_TOUCHED}, n AS (SELECT cache_id, count(*) AS total_tracked_keys FROM touched GROUP BY 1)
SELECT cache_id, total_tracked_keys, row_number() OVER (PARTITION BY cache_id ORDER BY last_access, last_seq)::INT AS lru_rank, key
FROM touched JOIN n USING (cache_id) QUALIFY lru_rank <= 10""")
def lru_sample(spark, sf):
    return lc.lru_sample(access_log(spark, sf))


@query("object_size", """SELECT d.doc_id, strlen(d.text)::BIGINT AS value_bytes, coalesce(4 * len(e.embedding), 0)::BIGINT AS vector_bytes
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def object_size(spark, sf):
    vectors = embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding")
    both = table(spark, sf, "documents").join(vectors, "doc_id", "left")
    return both.select("doc_id", value_bytes(F.col("text")).alias("value_bytes"), vector_bytes(F.col("embedding")).alias("vector_bytes"))


DISTANCE = LOG + """, pos AS (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY ts, seq) AS pos FROM log),
prev AS (SELECT *, lag(pos) OVER (PARTITION BY cache_id, key ORDER BY pos) AS prev FROM pos),
dist AS (SELECT a.cache_id, a.key, a.seq, any_value(a.prev) AS prev,
    CASE WHEN any_value(a.prev) IS NOT NULL THEN count(b.pos) END AS distance
  FROM prev a LEFT JOIN prev b ON b.cache_id = a.cache_id AND b.pos > a.prev AND b.pos < a.pos AND coalesce(b.prev, 0) <= a.prev
  GROUP BY 1, 2, 3)"""


@query("reuse_distance", f"WITH {DISTANCE} SELECT cache_id, key, seq, distance FROM dist")
def reuse_distance(spark, sf):
    return distances(access_log(spark, sf)).select("cache_id", "key", "seq", "distance")


@query("sliding_ttl_hits", f"""WITH {LOG} SELECT cache_id, key, seq,
  coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY cache_id, key ORDER BY ts, seq)) <= {DAY * 1_000_000}, false) AS hit FROM log""")
def sliding_ttl_hits(spark, sf):
    return lc.sliding_ttl_hits(access_log(spark, sf), DAY).select("cache_id", "key", "seq", "hit")


@query("fixed_ttl_hits", f"""WITH RECURSIVE {LOG}, s AS (SELECT cache_id, key, seq, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY cache_id, key ORDER BY ts, seq) AS rn FROM log),
f AS (SELECT cache_id, key, seq, rn, t AS loaded, false AS hit FROM s WHERE rn = 1
  UNION ALL SELECT s.cache_id, s.key, s.seq, s.rn, CASE WHEN s.t - f.loaded <= {DAY * 1_000_000} THEN f.loaded ELSE s.t END,
    s.t - f.loaded <= {DAY * 1_000_000} FROM f JOIN s ON s.cache_id = f.cache_id AND s.key = f.key AND s.rn = f.rn + 1)
SELECT cache_id, key, seq, hit FROM f""")
def fixed_ttl_hits(spark, sf):
    return lc.fixed_ttl_hits(access_log(spark, sf), DAY).select("cache_id", "key", "seq", "hit")


def replay_ops(spark, sf):
    """A cache per user: sets, gets and deletes with a day to live."""
    op = F.col("op")
    kind = F.when(op.isin("signup", "purchase"), "set").when(op.isin("view", "click"), "get").otherwise("delete")
    return access_log(spark, sf).select("cache_id", "key", "ts", "seq", kind.alias("op"), F.lit(DAY).alias("ttl"))


# The fold as SQL: a list of (key, expiry) per cache, least recently used first.
REPLAY = f"""{LOG}, o AS (SELECT cache_id, seq, key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY cache_id ORDER BY ts, seq) AS rn,
  CASE WHEN op IN ('signup', 'purchase') THEN 'set' WHEN op IN ('view', 'click') THEN 'get' ELSE 'delete' END AS op FROM log),
f AS (SELECT cache_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, []::STRUCT(k VARCHAR, e BIGINT)[] AS held, NULL::VARCHAR AS outcome, 0 AS evicted
  FROM (SELECT DISTINCT cache_id FROM o)
  UNION ALL SELECT cache_id, rn, seq,
    CASE WHEN op = 'set' THEN list_slice(moved, greatest(1, len(moved) - {C - 2}), len(moved))
      WHEN op = 'get' AND alive THEN moved WHEN op = 'get' AND NOT known THEN held ELSE others END,
    CASE WHEN op = 'set' THEN 'set' WHEN op = 'get' THEN CASE WHEN alive THEN 'hit' ELSE 'miss' END
      WHEN known THEN 'deleted' ELSE 'absent' END,
    CASE WHEN op = 'set' THEN greatest(0, len(moved) - {C - 1}) ELSE 0 END::INT
  FROM (SELECT *, list_append(others, {{'k': key, 'e': t + {DAY * 1_000_000}}}) AS moved FROM (
    SELECT o.cache_id, o.rn, o.seq, o.op, o.key, o.t, f.held, list_filter(f.held, lambda x: x.k <> o.key) AS others,
      len(list_filter(f.held, lambda x: x.k = o.key)) > 0 AS known,
      len(list_filter(f.held, lambda x: x.k = o.key AND o.t <= x.e)) > 0 AS alive
    FROM f JOIN o ON o.cache_id = f.cache_id AND o.rn = f.rn + 1)))"""


@query("batch_cache_replay", f"WITH RECURSIVE {REPLAY} SELECT cache_id, seq, outcome, evicted::INT AS evicted FROM f WHERE rn > 0")
def batch_cache_replay(spark, sf):
    return lc.cache_replay(replay_ops(spark, sf), C).select("cache_id", "seq", "outcome", "evicted")


@query("replay_hit_rates", f"""WITH RECURSIVE {REPLAY} SELECT cache_id, count(*) FILTER (outcome IN ('hit', 'miss')) AS requests,
  count(*) FILTER (outcome = 'hit') AS hits,
  CASE WHEN count(*) FILTER (outcome IN ('hit', 'miss')) = 0 THEN 0 ELSE
    round(100.0::DOUBLE * count(*) FILTER (outcome = 'hit') / count(*) FILTER (outcome IN ('hit', 'miss')), 2) END AS hit_rate
FROM f WHERE outcome IN ('hit', 'miss') GROUP BY 1""")
def replay_hit_rates(spark, sf):
    replayed = lc.cache_replay(replay_ops(spark, sf), C)
    gets = replayed.filter("outcome in ('hit', 'miss')").withColumn("hit", F.col("outcome") == "hit")
    return lc.hit_summary(gets)


@query("settings_problems", """WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'ttl' ELSE 'interval' END AS name,
  CASE event_id % 3 WHEN 0 THEN value / 50 - 0.5 ELSE value - 20 END AS value FROM events)
SELECT event_id, name, value, CASE WHEN value < 0 AND name <> 'interval' THEN name || ' is below 0' WHEN value < 1 AND name = 'interval' THEN 'interval is below 1'
  ELSE 'threshold is above 1' END AS problem FROM s
WHERE (name <> 'interval' AND value < 0) OR (name = 'interval' AND value < 1) OR (name = 'threshold' AND value > 1)""")
def settings_problems(spark, sf):
    """A setting per event; those a run would refuse."""
    kind = F.col("event_id") % 3
    value = F.when(kind == 0, F.col("value") / 50 - 0.5).otherwise(F.col("value") - 20)
    name = F.when(kind == 0, "threshold").when(kind == 1, "ttl").otherwise("interval")
    rows = table(spark, sf, "events").select("event_id", name.alias("name"), value.alias("value"))
    return rows.withColumn("problem", setting_problem(F.col("name"), F.col("value"))).filter("problem is not null")


@query("json_values", "SELECT event_id, (props->>'$.k')::BIGINT AS k, length(props)::INT AS size FROM events")
def json_values(spark, sf):
    """Stored JSON read into columns."""
    return table(spark, sf, "events").select(
        "event_id", parsed_value(F.col("props"), "k bigint")["k"].alias("k"), F.length("props").alias("size"))
