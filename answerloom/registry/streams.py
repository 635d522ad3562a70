"""The online twins, run over the event files until used up."""

from pyspark.sql import functions as F

from ..operators.changelog import replay
from ..session import new_path, stage
from ..sources.snapshots import read_snapshot
from ..streaming import answering, hitters, jobs
from ..streaming.run import run_to_parquet
from . import query
from .lifecycle import C, DAY, REPLAY
from .lookup import _BEST_LIVE, _cached
from .monitoring import POPULAR, _WINDOW
from .storage import STATE, _state
from .views import (
    ANSWERS, ANSWERS_NOW, LOG, OPS, SLOW_ALERTS, THRESHOLD, access_log, answer_index, answers, counted, op_log, requests, slow_alerts, table, us,
)


# The watermark trails the latest event, in whole milliseconds.
NOW_US = "(SELECT epoch_us(max(ts)) // 1000 * 1000 FROM ev)"


def _stream(spark, sf, name, folder=None):
    """A table's file as a stream; one file is one micro-batch."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder or sf)


def _events(spark, sf):
    return _stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").alias("k"),
    )


def _log(spark, sf):
    return _events(spark, sf).select(
        F.col("user_id").alias("cache_id"), F.col("k").alias("key"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("op"), "value",
    )


def _written(spark, df, name):
    """A derived table as a stream source."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _in_disorder(spark, df, name):
    """A log as a stream of micro-batches of ten days each, in which a row may be a day late."""
    path = new_path(spark, name)
    day = F.floor(F.unix_seconds("ts") / 86_400) + F.pmod(F.xxhash64("seq"), F.lit(2))
    dealt = stage(df.withColumn("_slot", F.floor(day / 10).cast("int")), name)
    for (slot,) in sorted(dealt.select("_slot").distinct().collect()):  # a few slots
        dealt.filter(F.col("_slot") == slot).drop("_slot").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


# A set is out if it ran out before the key's next write and before the
# watermark, two days behind the latest op (in whole milliseconds).
@query("stream_ttl_expiry", f"""WITH {OPS}, w AS (SELECT key, level, operation, epoch_us(ts) + ttl::BIGINT * 1000000 AS expires_at,
  lead(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, seq) AS following FROM ops WHERE operation IN ('set', 'delete'))
SELECT key, level, expires_at FROM w WHERE operation = 'set' AND (following IS NULL OR expires_at < following)
  AND expires_at // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 FROM ops WHERE operation IN ('set', 'delete')) - 2 * 86400000""")
def stream_ttl_expiry(spark, sf):
    """Three micro-batches or more, out of order."""
    ops = _in_disorder(spark, op_log(spark, sf), "ops")
    return run_to_parquet(jobs.ttl_expiry(ops, "2 days"), "expired").select("key", "level", *us("expires_at"))


@query("stream_cache_replay", f"WITH RECURSIVE {REPLAY} SELECT cache_id, seq, outcome, evicted::INT AS evicted FROM f WHERE rn > 0")
def stream_cache_replay(spark, sf):
    op = F.col("op")
    kind = F.when(op.isin("signup", "purchase"), "set").when(op.isin("view", "click"), "get").otherwise("delete")
    ops = _log(spark, sf).select("cache_id", "key", "ts", "seq", kind.alias("op"), F.lit(DAY).alias("ttl"))
    return run_to_parquet(jobs.cache_replay_stream(ops, C), "replay")


# Only windows that end by the watermark are out.
@query("stream_metrics", f"""WITH {LOG}, w AS ({_WINDOW})
SELECT *, CASE WHEN hits + misses = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * hits / (hits + misses), 2) END AS cache_hit_rate
FROM w WHERE ts + 3600000000 <= {NOW_US} - 600000000""")
def stream_metrics(spark, sf):
    out = run_to_parquet(jobs.metrics_stream(counted(_log(spark, sf)), "1 hour"), "metrics")
    return out.withColumn("ts", us("ts")[0])


@query("stream_access_counts", f"""WITH {LOG}, a AS (SELECT epoch_us(date_trunc('day', ts)) AS window_start, key, count(*) AS access_count,
  epoch_us(max(ts)) AS last_access FROM log GROUP BY 1, 2)
SELECT * FROM a WHERE window_start + 86400000000 <= {NOW_US} - 86400000000""")
def stream_access_counts(spark, sf):
    out = run_to_parquet(jobs.access_counts_stream(_log(spark, sf)), "accesses")
    return out.select(*us("window_start"), "key", "access_count", *us("last_access"))


@query("stream_popular_items", POPULAR)
def stream_popular_items(spark, sf):
    """The most frequent keys out of a summary kept over micro-batches, counted again in the stored log."""
    log = access_log(spark, sf)
    summary = hitters.summarise(_in_disorder(spark, log, "accesses"), new_path(spark, "popular"))
    return hitters.popular_items(log, summary).select("key", "access_count", *us("last_access"), "recent_accesses")


_SLIDE = 6 * 3_600_000_000


@query("stream_access_sliding", f"""WITH {LOG}, a AS (SELECT epoch_us(ts) // {_SLIDE} * {_SLIDE} - i * {_SLIDE} AS window_start, key,
  count(*) AS access_count, epoch_us(max(ts)) AS last_access FROM log, (SELECT unnest(range(4)) AS i) GROUP BY 1, 2)
SELECT * FROM a WHERE window_start + 86400000000 <= {NOW_US} - 86400000000""")
def stream_access_sliding(spark, sf):
    """A day's accesses, every six hours."""
    out = run_to_parquet(jobs.access_counts_stream(_log(spark, sf), slide="6 hours"), "accesses")
    return out.select(*us("window_start"), "key", "access_count", *us("last_access"))


@query("stream_semantic_lookup", f"WITH {_cached(_BEST_LIVE)} SELECT * FROM outcome")
def stream_semantic_lookup(spark, sf):
    asked = _written(spark, requests(spark, sf), "requests")
    return jobs.semantic_lookup_stream(asked, answers(spark, sf), answer_index(spark, sf), ANSWERS_NOW, THRESHOLD)


def _replayed(batches: int) -> str:
    """Batch after batch in SQL: what batch n asks of c<n>, and c<n+1> with the answers to what it missed."""
    parts = ["c0 AS (SELECT l.key, l.value, x.e FROM live l JOIN x ON x.query = l.key)"]
    for n in range(batches):
        parts.append(f"""m{n} AS (SELECT r.qid, c.key, c.value, round(list_cosine_similarity(r.e, c.e), 6) AS sim FROM asked r, c{n} c WHERE r.b = {n}
  QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY round(list_cosine_similarity(r.e, c.e), 6) DESC, c.key) = 1),
o{n} AS (SELECT r.qid, r.query, r.e, CASE WHEN c.key IS NOT NULL THEN 'exact' WHEN m.sim >= {THRESHOLD} THEN 'semantic' ELSE 'miss' END AS source,
  CASE WHEN c.key IS NOT NULL THEN r.query WHEN m.sim >= {THRESHOLD} THEN m.key END AS matched_query,
  CASE WHEN c.key IS NOT NULL THEN 1.0::DOUBLE WHEN m.sim >= {THRESHOLD} THEN m.sim END AS sim,
  CASE WHEN c.key IS NOT NULL THEN c.value WHEN m.sim >= {THRESHOLD} THEN m.value END AS value
  FROM asked r LEFT JOIN c{n} c ON c.key = r.query LEFT JOIN m{n} m ON m.qid = r.qid WHERE r.b = {n}),
c{n + 1} AS (SELECT * FROM c{n} UNION ALL SELECT query, 'Fresh: ' || query, e FROM o{n} WHERE source = 'miss'
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY qid) = 1)""")
    return ",\n".join(parts)


@query("stream_answering", f"""WITH {ANSWERS}, asked AS (SELECT qid, query, e, qid // 2 % 3 AS b FROM req
  UNION ALL SELECT qid + 10000000, 'Once more: ' || query, e, (qid // 2 + 1) % 3 FROM req), {_replayed(3)}
{' UNION ALL '.join(f'SELECT qid, query, source, matched_query, sim, value FROM o{n}' for n in range(3))}""")
def stream_answering(spark, sf):
    """Three micro-batches; what one had to fetch, later ones find, word for word or by its vector."""
    base = requests(spark, sf).withColumn("b", F.floor(F.col("qid") / 2) % 3)
    more = base.select(
        (F.col("qid") + 10_000_000).alias("qid"), F.concat(F.lit("Once more: "), "query").alias("query"), "embedding", ((F.floor(F.col("qid") / 2) + 1) % 3).alias("b"))
    asked, path = stage(base.unionByName(more), "requests"), new_path(spark, "requests")
    for n in range(3):
        asked.filter(F.col("b") == n).drop("b").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(asked.drop("b").schema).option("maxFilesPerTrigger", 1).parquet(path)

    def fetch(missed):
        return missed.select("query", F.concat(F.lit("Fresh: "), "query").alias("value"), F.lit(864_000).alias("ttl"))

    out = answering.answering_stream(
        source, answers(spark, sf), answer_index(spark, sf), new_path(spark, "answering"), ANSWERS_NOW, fetch, THRESHOLD)
    return out.select("qid", "query", "source", "matched_query", "sim", "value")


@query("stream_alert_cooldown", f"""WITH RECURSIVE {SLOW_ALERTS}, s AS (SELECT level, category, message, seq, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY level, category, message ORDER BY ts, seq) AS rn FROM raw),
f AS (SELECT level, category, message, seq, t, rn, t AS last, true AS emitted FROM s WHERE rn = 1
  UNION ALL SELECT s.level, s.category, s.message, s.seq, s.t, s.rn, CASE WHEN s.t - f.last >= 21600000000 THEN s.t ELSE f.last END,
    s.t - f.last >= 21600000000 FROM f JOIN s ON s.level = f.level AND s.message = f.message AND s.rn = f.rn + 1)
SELECT t AS ts, level, category, message, seq FROM f WHERE emitted""")
def stream_alert_cooldown(spark, sf):
    raw = _written(spark, slow_alerts(spark, sf), "alerts")
    out = run_to_parquet(jobs.alert_cooldown_stream(raw, 6 * 3600), "alerts-out")
    return out.select(*us("ts"), "level", "category", "message", "seq")


@query("stream_state", f"WITH {OPS}, {STATE} SELECT * FROM state")
def stream_state(spark, sf):
    """Micro-batches out of order, with clears and deletes among them."""
    ops = op_log(spark, sf)
    empty = replay(ops.limit(0))
    return _state(jobs.state_stream(_in_disorder(spark, ops, "ops"), empty, new_path(spark, "versions")))


@query("stream_snapshots", f"WITH {OPS}, {STATE} SELECT * FROM state")
def stream_snapshots(spark, sf):
    """A snapshot per micro-batch; the latest is the whole state."""
    ops = op_log(spark, sf)
    empty = replay(ops.limit(0))
    path = new_path(spark, "stream-snapshots")
    jobs.state_stream(_in_disorder(spark, ops, "ops"), empty, new_path(spark, "versions"), path)
    return _state(read_snapshot(spark, path, empty.schema))
