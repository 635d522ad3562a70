"""The tables the operators need, read off the given ones, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.entries import TTL_BY_LEVEL, expires_at, ttl_for
from ..schemas import LEVELS
from ..session import spread

THRESHOLD = 0.35  # the given vectors are far apart: their best matches score up to 0.49
ANSWERS_NOW = datetime(2024, 1, 11, tzinfo=timezone.utc)
SPAN = 1 << 22  # more than the chunks of the longest text and than any conversation's turns
TTL_SCALE = 288  # lifetimes of minutes become days, as the log spans a month

_now: dict[str, datetime] = {}


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    if (sf, name) not in _schemas:
        _schemas[sf, name] = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.read.schema(_schemas[sf, name]).parquet(f"{sf}/{name}.parquet")


def us(*names: str):
    return [F.unix_micros(F.col(n).cast("timestamp")).alias(n) for n in names]


def level_of(c):
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col(c) % 4 + 1).cast("int"))


# ------------------------------------------------------------------ events

def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").alias("k"),
    )


EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props,
  json_extract_string(props, '$.k') AS k FROM events)"""
NOW = "(SELECT max(ts) FROM ev)"


def now(spark, sf) -> datetime:
    """The last event's time, a value of the fixture (one row)."""
    if sf not in _now:
        _now[sf] = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return _now[sf]


def access_log(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.col("user_id").alias("cache_id"), F.col("k").alias("key"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("op"), "value",
    )


LOG = EV + """, log AS (SELECT user_id AS cache_id, k AS key, ts, event_id AS seq, event_type AS op, value FROM ev)"""


def _operation():
    kind = F.col("event_type")
    return (
        F.when(F.col("event_id") % 997 == 0, "clear").when(kind.isin("signup", "purchase"), "set")
        .when(kind.isin("view", "click"), "get").otherwise("delete")
    )


def op_log(spark, sf) -> DataFrame:
    level = level_of("event_id")
    ops = events(spark, sf).withColumn("operation", _operation())
    is_clear, is_set = F.col("operation") == "clear", F.col("operation") == "set"
    return ops.select(
        "ts", F.col("event_id").alias("seq"), "operation", F.when(~is_clear, F.col("k")).alias("key"),
        F.when(~is_clear | (F.col("event_id") % 2 == 1), level).alias("level"),
        F.when(is_set, F.col("props")).alias("value"), F.when(is_set, ttl_for(level)).alias("ttl"),
    )


_TTL = "CASE lvl " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TTL_BY_LEVEL.items()) + " END"
_LEVELS = "[" + ", ".join(f"'{x}'" for x in LEVELS) + "]"
OPS = EV + f""", ops0 AS (SELECT *, {_LEVELS}[(event_id % 4 + 1)::INT] AS lvl,
  CASE WHEN event_id % 997 = 0 THEN 'clear' WHEN event_type IN ('signup', 'purchase') THEN 'set'
       WHEN event_type IN ('view', 'click') THEN 'get' ELSE 'delete' END AS operation FROM ev),
ops AS (SELECT ts, event_id AS seq, operation, CASE WHEN operation <> 'clear' THEN k END AS key,
  CASE WHEN operation <> 'clear' OR event_id % 2 = 1 THEN lvl END AS level,
  CASE WHEN operation = 'set' THEN props END AS value,
  CASE WHEN operation = 'set' THEN {_TTL} END AS ttl FROM ops0)"""


def entries(spark, sf) -> DataFrame:
    """Last set or delete per (key, level), deletes gone; access figures from the log."""
    ops = op_log(spark, sf).filter("operation in ('set', 'delete')")
    last = ops.groupBy("key", "level").agg(
        F.max_by(F.struct("operation", "value", "ts", "ttl"), F.struct("ts", "seq")).alias("w")
    )
    kept = last.filter("w.operation = 'set'").select(
        "key", "level", "w.value", F.col("w.ts").alias("created_at"), (F.col("w.ttl") * TTL_SCALE).alias("ttl_s")
    )
    used = access_log(spark, sf).groupBy("key").agg(
        F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("access_count")
    )
    return (
        kept.withColumn("expires_at", expires_at(F.col("created_at"), F.col("ttl_s")))
        .withColumn("size_bytes", (F.octet_length("key") + F.octet_length("value")).cast("bigint"))
        .join(used, "key", "left")
    )


ENTRIES = OPS + f""", last0 AS (
  SELECT key, level, arg_max(operation, (ts, seq)) AS operation, arg_max(value, (ts, seq)) AS value,
    arg_max(ttl, (ts, seq)) AS ttl, max(ts) AS created_at
  FROM ops WHERE operation IN ('set', 'delete') GROUP BY key, level),
used AS (SELECT k AS key, max(ts) AS last_access, count(*) AS access_count FROM ev GROUP BY k),
entries AS (
  SELECT l.key, level, value, created_at, ttl * {TTL_SCALE} AS ttl_s,
    created_at + to_seconds(ttl * {TTL_SCALE}) AS expires_at,
    (strlen(l.key) + strlen(value))::BIGINT AS size_bytes, last_access, access_count
  FROM last0 l LEFT JOIN used USING (key) WHERE operation = 'set')"""


def counted(log: DataFrame) -> DataFrame:
    """What counts as hit, miss and set in the given events."""
    op = F.col("op")
    return log.withColumns({
        "is_hit": op.isin("view", "click"), "is_miss": op == "error", "is_set": op.isin("signup", "purchase"),
    })


def metrics_history(spark, sf) -> DataFrame:
    """One sample per hour."""
    hourly = counted(events(spark, sf).withColumnRenamed("event_type", "op")).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count_if("is_hit").alias("hits"), F.count_if("is_miss").alias("misses"), F.count_if("is_set").alias("sets"),
        F.round(F.sum("value"), 2).alias("memory"), F.avg("value").alias("_mean"),
        F.count_distinct("k").alias("cache_total_entries"),
    )
    rate = F.coalesce(F.try_divide(F.col("hits") * F.lit(100.0), F.col("hits") + F.col("misses")), F.lit(0.0))
    return hourly.withColumns({
        "cache_hit_rate": F.round(rate, 2),
        "cache_memory_usage": F.round(F.least(F.lit(100.0), F.col("_mean") * 1.4), 2),
    }).drop("_mean")


HISTORY = EV + """, history0 AS (SELECT date_trunc('hour', ts) AS ts,
  count(*) FILTER (event_type IN ('view', 'click')) AS hits, count(*) FILTER (event_type = 'error') AS misses,
  count(*) FILTER (event_type IN ('signup', 'purchase')) AS sets, round(sum(value), 2) AS memory,
  avg(value) AS mean, count(DISTINCT k) AS cache_total_entries FROM ev GROUP BY 1),
history AS (SELECT ts, hits, misses, sets, memory, cache_total_entries,
  round(CASE WHEN hits + misses = 0 THEN 0 ELSE hits * 100.0::DOUBLE / (hits + misses) END, 2) AS cache_hit_rate,
  round(least(100.0::DOUBLE, mean * 1.4::DOUBLE), 2) AS cache_memory_usage FROM history0)"""

ALERTS = HISTORY + """, alerts AS (
  SELECT ts, 'critical' AS level, 'memory' AS category,
    'Cache memory usage critical: ' || round(cache_memory_usage, 1)::VARCHAR || '%' AS message
  FROM history WHERE cache_memory_usage / 100 >= 0.95
  UNION ALL SELECT ts, 'warning', 'memory',
    'Cache memory usage high: ' || round(cache_memory_usage, 1)::VARCHAR || '%'
  FROM history WHERE cache_memory_usage / 100 >= 0.8 AND cache_memory_usage / 100 < 0.95
  UNION ALL SELECT ts, 'warning', 'performance',
    'Cache hit rate low: ' || round(cache_hit_rate, 1)::VARCHAR || '%'
  FROM history WHERE cache_hit_rate / 100 < 0.3)"""


def slow_alerts(spark, sf) -> DataFrame:
    """An alert per error event; the message names its key."""
    return events(spark, sf).filter("event_type = 'error'").select(
        "ts", F.col("event_id").alias("seq"), F.when(F.col("value") > 50, "critical").otherwise("warning").alias("level"),
        F.lit("performance").alias("category"), F.concat(F.lit("Slow key "), "k").alias("message"),
    )


SLOW_ALERTS = EV + """, raw AS (SELECT ts, event_id AS seq, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS level,
  'performance' AS category, 'Slow key ' || k AS message FROM ev WHERE event_type = 'error')"""


# -------------------------------------------------------------- embeddings

def _name(c: str = "vec_id"):
    return F.concat(F.lit("Question number "), F.col(c).cast("string"), F.lit("?"))


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _new_name(c: str = "vec_id"):
    return F.concat(F.lit("New question "), F.col(c).cast("string"), F.lit("?"))


def questions(spark, sf) -> DataFrame:
    """A new question per stored one: its vector read backwards, so not its own neighbour."""
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("qid"), _new_name().alias("query"), F.reverse("embedding").alias("embedding")
    )


def index_rows(spark, sf) -> DataFrame:
    return embeddings(spark, sf).select(
        "vec_id", level_of("vec_id").alias("level"), _name().alias("query"),
        (F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)) + F.make_dt_interval(mins=F.col("vec_id").cast("int"))).alias("ts"),
        "embedding", "label",
    )


VECTORS = f"""q AS (SELECT vec_id AS qid, 'New question ' || vec_id || '?' AS query, list_reverse(embedding)::DOUBLE[] AS e
  FROM embeddings),
x AS (SELECT vec_id, {_LEVELS}[(vec_id % 4 + 1)::INT] AS level, 'Question number ' || vec_id || '?' AS query,
  TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS ts, embedding::DOUBLE[] AS e, label
  FROM embeddings)"""
SCORES = VECTORS + """, scores AS (SELECT qid, vec_id, level, round(list_cosine_similarity(q.e, x.e), 6) AS sim FROM q, x)"""


def answers(spark, sf) -> DataFrame:
    """An answer per index row, level result; lifetimes of one to ten days by label."""
    start = F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc))
    rows = embeddings(spark, sf).select(
        _name().alias("key"), F.lit("result").alias("level"),
        F.concat(F.lit("Answer to "), F.col("vec_id").cast("string")).alias("value"),
        (start + F.make_dt_interval(hours=(F.col("vec_id") % 240).cast("int"))).alias("created_at"),
        ((F.col("label") + 1) * 86400).cast("int").alias("ttl_s"),
    )
    return rows.withColumn("expires_at", expires_at(F.col("created_at"), F.col("ttl_s")))


def answer_index(spark, sf) -> DataFrame:
    return index_rows(spark, sf).withColumn("level", F.lit("result"))


def requests(spark, sf) -> DataFrame:
    """The new questions, and every stored one asked word for word again."""
    again = embeddings(spark, sf).select((F.col("vec_id") * 2 + 1).alias("qid"), _name().alias("query"), "embedding")
    return questions(spark, sf).withColumn("qid", F.col("qid") * 2).unionByName(again)


ANSWERS = VECTORS + """, answers AS (SELECT vec_id, query AS key, 'Answer to ' || vec_id AS value,
  TIMESTAMP '2024-01-01' + to_hours(vec_id % 240) AS created_at, ((label + 1) * 86400)::INT AS ttl_s,
  TIMESTAMP '2024-01-01' + to_hours(vec_id % 240) + to_seconds((label + 1) * 86400) AS expires_at FROM x),
live AS (SELECT * FROM answers WHERE NOT (TIMESTAMP '2024-01-11' > expires_at)),
req AS (SELECT qid * 2 AS qid, query, e FROM q UNION ALL SELECT vec_id * 2 + 1, query, e FROM x),
scored AS (SELECT qid, vec_id, x.query AS matched_query, round(list_cosine_similarity(req.e, x.e), 6) AS sim FROM req, x)"""


def pairs(spark, sf) -> DataFrame:
    """Each even vector with the next one; duplicates share the label."""
    v = embeddings(spark, sf).select("vec_id", "label")
    a = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("q1"), F.col("label").alias("l1"))
    b = v.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("q2"), (F.col("vec_id") - 1).alias("q1"), F.col("label").alias("l2"))
    return a.join(b, "q1").select(
        (F.col("q1") / 2).cast("bigint").alias("pair_id"), "q1", "q2", (F.col("l1") == F.col("l2")).cast("int").alias("is_duplicate")
    )


PAIRS = """pairs AS (SELECT (a.vec_id // 2)::BIGINT AS pair_id, a.vec_id AS q1, b.vec_id AS q2,
  (a.label = b.label)::INT AS is_duplicate, a.embedding::DOUBLE[] AS e1, b.embedding::DOUBLE[] AS e2
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""
BEST = PAIRS + """, best AS (SELECT p.pair_id, p.q1, p.q2, p.is_duplicate, o.q1 AS best_id,
  round(list_cosine_similarity(p.e2, o.e1), 6) AS best_sim FROM pairs p, pairs o
  QUALIFY row_number() OVER (PARTITION BY p.pair_id ORDER BY round(list_cosine_similarity(p.e2, o.e1), 6) DESC, o.q1) = 1)"""


# -------------------------------------------------------------------- text

def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * SPAN + F.col("turn")).alias("qid"), F.col("text").alias("query"), "role"
    )


def user_turns(spark, sf) -> DataFrame:
    return turns(spark, sf).filter("role = 'user'").drop("role")


NORMAL = (
    r"regexp_replace(trim(regexp_replace(lower({0}), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')), "
    r"'[^\p{{L}}\p{{N}}_\s]', '', 'g')"
)
