"""Lookups: exact, by priority, semantic, writing back."""

from pyspark.sql import functions as F

from ..operators import lookup as lk, monitor as mo, similarity as sm
from ..operators.answers import hashing_embedder
from ..plans.search import side
from ..plans.tree import Tree
from ..session import new_path
from . import query
from .views import (
    ANSWERS, ANSWERS_NOW, ENTRIES, NOW, THRESHOLD, answer_index, answers, entries, now, op_log, requests, us,
)

T = THRESHOLD
_LIVE = f"live AS (SELECT * FROM entries WHERE NOT coalesce({NOW} > expires_at, false))"
_FIRST = """first AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key
  ORDER BY list_position(['query', 'embedding', 'context', 'result'], level)) = 1)"""


def _gets(spark, sf):
    return op_log(spark, sf).filter("operation = 'get'").select("seq", "key", "level")


@query("exact_lookup", f"""WITH {ENTRIES}, {_LIVE}
SELECT o.seq, o.key, o.level, l.value, l.value IS NOT NULL AS hit
FROM ops o LEFT JOIN live l ON l.key = o.key AND l.level = o.level WHERE o.operation = 'get'""")
def exact_lookup(spark, sf):
    out = lk.exact_lookup(_gets(spark, sf), entries(spark, sf), now(spark, sf))
    return out.select("seq", "key", "level", "value", "hit")


@query("exact_lookup_auto", f"""WITH {ENTRIES}, {_FIRST}
SELECT o.seq, o.key, f.level AS found_level, f.value, f.value IS NOT NULL AS hit
FROM ops o LEFT JOIN first f ON f.key = o.key AND NOT ({NOW} > f.expires_at) WHERE o.operation = 'get'""")
def exact_lookup_auto(spark, sf):
    out = lk.exact_lookup_auto(_gets(spark, sf).drop("level"), entries(spark, sf), now(spark, sf))
    return out.select("seq", "key", "found_level", "value", "hit")


@query("exists_semi", f"""WITH {ENTRIES}, {_LIVE}
SELECT o.seq, o.key, o.level FROM ops o WHERE o.operation = 'get'
  AND EXISTS (SELECT 1 FROM live l WHERE l.key = o.key AND l.level = o.level)""")
def exists_semi(spark, sf):
    return lk.existing(_gets(spark, sf), entries(spark, sf), now(spark, sf)).select("seq", "key", "level")


@query("missing_anti", f"""WITH {ENTRIES}, {_FIRST}
SELECT o.seq, o.key, o.level FROM ops o WHERE o.operation = 'get'
  AND NOT EXISTS (SELECT 1 FROM first f WHERE f.key = o.key AND NOT ({NOW} > f.expires_at))""")
def missing_anti(spark, sf):
    return lk.missing(_gets(spark, sf), entries(spark, sf), now(spark, sf), auto=True).select("seq", "key", "level")


_BEST_ALL = """best AS (SELECT qid, vec_id, matched_query, sim FROM scored
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) = 1)"""
_BEST_LIVE = """best AS (SELECT qid, vec_id, matched_query, sim FROM scored
  WHERE matched_query IN (SELECT key FROM live)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) = 1)"""
_MATCH = f"""SELECT b.qid, b.matched_query, b.sim, l.value
FROM best b JOIN live l ON l.key = b.matched_query WHERE b.sim >= {T}"""


def _match(spark, sf, scope):
    return lk.semantic_match(
        requests(spark, sf), answers(spark, sf), answer_index(spark, sf), ANSWERS_NOW, T, scope=scope
    )


@query("semantic_match_all", f"WITH {ANSWERS}, {_BEST_ALL} {_MATCH}")
def semantic_match_all(spark, sf):
    return _match(spark, sf, "all")


@query("semantic_match_live", f"WITH {ANSWERS}, {_BEST_LIVE} {_MATCH}")
def semantic_match_live(spark, sf):
    return _match(spark, sf, "live")


def _cached(best):
    return f"""{ANSWERS}, {best},
sem AS ({_MATCH}),
outcome AS (SELECT r.qid, r.query,
  CASE WHEN l.value IS NOT NULL THEN 'exact' WHEN s.value IS NOT NULL THEN 'semantic' ELSE 'miss' END AS source,
  CASE WHEN l.value IS NOT NULL THEN r.query ELSE s.matched_query END AS matched_query,
  CASE WHEN l.value IS NOT NULL THEN 1.0::DOUBLE ELSE s.sim END AS sim, coalesce(l.value, s.value) AS value
FROM req r LEFT JOIN live l ON l.key = r.query LEFT JOIN sem s ON s.qid = r.qid)"""


def cached(spark, sf, scope="live"):
    return lk.cached_answer(
        requests(spark, sf), answers(spark, sf), answer_index(spark, sf), ANSWERS_NOW, T, scope=scope
    )


@query("cached_answer", f"WITH {_cached(_BEST_LIVE)} SELECT * FROM outcome")
def cached_answer(spark, sf):
    return cached(spark, sf)


@query("cached_answer_saved", f"WITH {_cached(_BEST_LIVE)} SELECT * FROM outcome")
def cached_answer_saved(spark, sf):
    """The index is placed once and read back; the lookup gets no vectors but those."""
    index, path = answer_index(spark, sf), new_path(spark, "saved-index")
    Tree.build(side(index, "vec_id", "embedding", "vec_id"), path)
    return lk.cached_answer(
        requests(spark, sf), answers(spark, sf), index.drop("embedding"), ANSWERS_NOW, T, placed=Tree.read(spark, path))


@query("cached_answer_all", f"WITH {_cached(_BEST_ALL)} SELECT * FROM outcome")
def cached_answer_all(spark, sf):
    return cached(spark, sf, "all")


@query("hit_stats", f"""WITH {_cached(_BEST_ALL)},
o AS (SELECT o.*, TIMESTAMP '2024-01-10' + to_minutes(o.qid) AS ts, coalesce(o.source = 'miss' AND b.sim >= {T}, false) AS dead
  FROM outcome o LEFT JOIN best b USING (qid)),
c AS (SELECT count(*) AS requests, count(*) FILTER (source = 'exact') AS exact_hits,
  count(*) FILTER (source = 'semantic') AS semantic_hits, count(*) FILTER (source = 'miss') AS misses,
  count(*) FILTER (dead) AS dead_matches, epoch_us(min(ts)) AS oldest_access, epoch_us(max(ts)) AS newest_access FROM o)
SELECT *, round(100.0::DOUBLE * (exact_hits + semantic_hits) / requests, 2) AS hit_rate,
  round(100.0::DOUBLE * (exact_hits + 2 * semantic_hits) / (exact_hits + 3 * semantic_hits + misses + dead_matches), 2) AS hit_rate_reference
FROM c""")
def hit_stats(spark, sf):
    best = sm.best_match(requests(spark, sf), answer_index(spark, sf), T).select("qid", F.lit(True).alias("any"))
    start = F.lit("2024-01-10").cast("timestamp")
    outcomes = cached(spark, sf, "all").join(best, "qid", "left").select(
        (start + F.make_dt_interval(mins=F.col("qid").cast("int"))).alias("ts"), "source",
        F.coalesce("any", F.lit(False)).alias("dead_match"),
    )
    return mo.hit_stats(outcomes).withColumns(dict(zip(("oldest_access", "newest_access"), us("oldest_access", "newest_access"))))


@query("store_answers", f"""WITH {ANSWERS}, w AS (
  SELECT key, 'result' AS level, value, created_at, ttl_s, 0 AS new FROM answers
  UNION ALL SELECT query, CASE WHEN qid % 2 = 0 THEN 'result' ELSE 'query' END,
    CASE WHEN qid % 2 = 0 THEN '{{"answer": "' || qid || '"}}' ELSE 'Answer ' || qid END, TIMESTAMP '2024-01-05' + to_hours(qid % 150), CASE WHEN qid % 2 = 0 THEN 3600 ELSE 300 END, 1 FROM req)
SELECT key, level, value, epoch_us(created_at) AS created_at, ttl_s::INT AS ttl_s FROM w
QUALIFY row_number() OVER (PARTITION BY key, level ORDER BY created_at DESC, new DESC) = 1""")
def store_answers(spark, sf):
    """Level, lifetime and entries of new answers; the index rows are tested by hand."""
    even, start = F.col("qid") % 2 == 0, F.lit("2024-01-05").cast("timestamp")
    qid = F.col("qid").cast("string")
    fresh = requests(spark, sf).select(
        F.col("query").alias("key"), F.lit(None).cast("string").alias("level"),
        F.when(even, F.concat(F.lit('{"answer": "'), qid, F.lit('"}'))).otherwise(F.concat(F.lit("Answer "), qid)).alias("value"),
        F.lit(None).cast("int").alias("ttl"), (start + F.make_dt_interval(hours=(F.col("qid") % 150).cast("int"))).alias("ts"))
    stored, _ = lk.store_answers(fresh, answers(spark, sf), hashing_embedder(64))
    return stored.select("key", "level", "value", *us("created_at"), "ttl_s")


@query("write_back", f"""WITH {ANSWERS}, w AS (
  SELECT key, value, created_at, ttl_s, expires_at, 0 AS new FROM answers
  UNION ALL SELECT query, 'New answer to ' || qid, TIMESTAMP '2024-01-05' + to_hours(qid % 150), 3600 * 24,
    TIMESTAMP '2024-01-05' + to_hours(qid % 150) + to_seconds(3600 * 24), 1 FROM req)
SELECT key, 'result' AS level, value, epoch_us(created_at) AS created_at, ttl_s::INT AS ttl_s, epoch_us(expires_at) AS expires_at
FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, new DESC) = 1""")
def write_back(spark, sf):
    start = F.lit("2024-01-05").cast("timestamp")
    fresh = requests(spark, sf).select(
        F.col("query").alias("key"), F.lit("result").alias("level"),
        F.concat(F.lit("New answer to "), F.col("qid").cast("string")).alias("value"), F.lit(None).cast("int").alias("ttl"),
        (start + F.make_dt_interval(hours=(F.col("qid") % 150).cast("int"))).alias("ts"),
    )
    out = lk.write_back(fresh, answers(spark, sf), ttl_scale=24)
    return out.select("key", "level", "value", *us("created_at"), "ttl_s", *us("expires_at"))
