"""Operation logs, snapshots, replaying and retention."""

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import changelog as cl
from ..session import new_path
from ..sources import oplog, pairs as ps, reports, snapshots as sn
from . import query
from .views import ENTRIES, LOG, NOW, OPS, PAIRS, access_log, documents, embeddings, entries, now, op_log, pairs, us


@query("pair_scan_limit", f"WITH {PAIRS} SELECT pair_id, q1, q2, is_duplicate FROM pairs ORDER BY pair_id LIMIT 100")
def pair_scan_limit(spark, sf):
    """Through CSV: written, read with its schema, first rows in id order."""
    path = new_path(spark, "pairs")
    pairs(spark, sf).write.option("header", True).csv(path)
    schema = "pair_id bigint, q1 bigint, q2 bigint, is_duplicate int"
    return ps.first_rows(ps.valid_pairs(ps.read_pairs_csv(spark, path, schema)), 100, "pair_id")


@query("oplog_project", f"""WITH {OPS} SELECT epoch_us(ts) AS ts, seq, operation, key, level, value, ttl::INT AS ttl,
  strftime(ts, '%Y-%m-%d') AS log_date FROM ops""")
def oplog_project(spark, sf):
    log = cl.project_log(op_log(spark, sf))
    return log.select(
        *us("ts"), "seq", "operation", "key", "level", "value", "ttl", F.col("log_date").cast("string").alias("log_date")
    )


@query("oplog_since", f"""WITH {OPS} SELECT epoch_us(ts) AS ts, seq, operation, key, level, value, ttl::INT AS ttl
FROM ops WHERE ts > {NOW} - INTERVAL 10 DAY""")
def oplog_since(spark, sf):
    """Written as JSON day folders, read back after a time."""
    path = new_path(spark, "oplog")
    oplog.append_log(op_log(spark, sf), path)
    log = oplog.read_log(spark, path, now(spark, sf) - timedelta(days=10))
    return log.select(*us("ts"), "seq", "operation", "key", "level", "value", "ttl")


STATE = f"""pos AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS pos FROM ops),
clears AS (SELECT l.level, max(p.pos) AS cleared FROM pos p, (SELECT unnest(['query', 'embedding', 'context', 'result']) AS level) l
  WHERE p.operation = 'clear' AND (p.level IS NULL OR p.level = l.level) GROUP BY 1),
w AS (SELECT key, level, arg_max(operation, pos) AS operation, arg_max(value, pos) AS value, arg_max(ts, pos) AS created_at,
  max(pos) AS pos FROM pos WHERE operation IN ('set', 'delete') GROUP BY 1, 2),
marks AS (SELECT key, arg_max(operation, pos) AS operation, arg_max(level, pos) AS level, arg_max(ts, pos) AS ts,
  arg_max(ttl, pos) AS ttl, max(pos) AS pos FROM pos WHERE operation IN ('set', 'delete') GROUP BY 1),
lives AS (SELECT m.key, m.ts + to_seconds(m.ttl) AS expires_at FROM marks m LEFT JOIN clears c ON c.level = m.level
  WHERE m.operation = 'set' AND (c.cleared IS NULL OR m.pos > c.cleared)),
state AS (SELECT w.key, w.level, w.value, epoch_us(w.created_at) AS created_at, epoch_us(l.expires_at) AS expires_at
  FROM w LEFT JOIN clears c ON c.level = w.level LEFT JOIN lives l ON l.key = w.key
  WHERE w.operation = 'set' AND (c.cleared IS NULL OR w.pos > c.cleared))"""


def _state(df):
    return df.select("key", "level", "value", *us("created_at", "expires_at"))


@query("oplog_replay", f"WITH {OPS}, {STATE} SELECT * FROM state")
def oplog_replay(spark, sf):
    return _state(cl.replay(op_log(spark, sf)))


@query("recover_state", f"WITH {OPS}, {STATE} SELECT * FROM state")
def recover_state(spark, sf):
    """State at a time written as a snapshot, then the log after it."""
    ops, at = op_log(spark, sf), now(spark, sf) - timedelta(days=9)
    early = cl.replay(ops.filter(F.col("ts") <= F.lit(at)))
    path = new_path(spark, "snapshots")
    sn.write_snapshot(early, path, at)
    return _state(cl.recover(sn.read_snapshot(spark, path, early.schema), ops, at))


@query("oplog_stats", f"""WITH {OPS} SELECT count(*) AS operations_logged, count(*) FILTER (operation = 'set') AS sets,
  count(*) FILTER (operation = 'get') AS gets, count(*) FILTER (operation = 'delete') AS deletes,
  count(*) FILTER (operation = 'clear') AS clears, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM ops""")
def oplog_stats(spark, sf):
    out = cl.log_stats(op_log(spark, sf))
    return out.withColumns(dict(zip(("first_ts", "last_ts"), us("first_ts", "last_ts"))))


def _write_three(spark, sf, path):
    e, at = entries(spark, sf), now(spark, sf)
    for days in (4, 2, 0):
        t = at - timedelta(days=days)
        sn.write_snapshot(e.filter(F.col("created_at") <= F.lit(t)), path, t)
    return e


@query("snapshot_latest", f"""WITH {ENTRIES} SELECT key, level, value, epoch_us(created_at) AS created_at, access_count FROM entries""")
def snapshot_latest(spark, sf):
    path = new_path(spark, "snapshots")
    e = _write_three(spark, sf, path)
    return sn.read_snapshot(spark, path, e.schema).select("key", "level", "value", *us("created_at"), "access_count")


@query("snapshot_named", f"""WITH {ENTRIES} SELECT key, level, value FROM entries WHERE created_at <= {NOW} - INTERVAL 2 DAY""")
def snapshot_named(spark, sf):
    path = new_path(spark, "snapshots")
    e = _write_three(spark, sf, path)
    name = (now(spark, sf) - timedelta(days=2)).strftime(sn.NAME_FORMAT)
    return sn.read_snapshot(spark, path, e.schema, name).select("key", "level", "value")


@query("snapshot_roundtrip", f"""WITH {ENTRIES}, v AS (SELECT vec_id::VARCHAR AS key, embedding FROM embeddings)
SELECT e.key, level, value, epoch_us(expires_at) AS expires_at, epoch_us(last_access) AS last_access, access_count,
  len(v.embedding)::INT AS dims FROM entries e LEFT JOIN v USING (key)""")
def snapshot_roundtrip(spark, sf):
    """Entries, lifetimes, accesses and vectors in one snapshot, read back."""
    vectors = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("key"), "embedding")
    state = entries(spark, sf).join(vectors, "key", "left")
    path = new_path(spark, "snapshots")
    sn.write_snapshot(state, path, now(spark, sf))
    back = sn.read_snapshot(spark, path, state.schema)
    return back.select("key", "level", "value", *us("expires_at", "last_access"), "access_count", F.size("embedding").alias("dims"))


@query("snapshot_info", f"""WITH {LOG}, d AS (SELECT unnest([0, 2, 4]) AS days)
SELECT strftime({NOW} - to_days(days::INT), '%Y%m%d_%H%M%S') AS snapshot_ts, true AS has_files FROM d""")
def snapshot_info(spark, sf):
    path = new_path(spark, "snapshots")
    _write_three(spark, sf, path)
    return sn.snapshot_info(spark, path).select("snapshot_ts", (F.col("files") > 0).alias("has_files"))


@query("retention_keep_n", f"""WITH {LOG}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS snapshot_ts, count(*) AS n FROM log GROUP BY 1)
SELECT snapshot_ts, n FROM d WHERE snapshot_ts NOT IN (SELECT snapshot_ts FROM d ORDER BY 1 DESC LIMIT 5)""")
def retention_keep_n(spark, sf):
    days = access_log(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot_ts")).agg(F.count(F.lit(1)).alias("n"))
    return cl.keep_newest(days, 5)


@query("retention_by_age", f"""WITH {OPS}, f AS (SELECT strftime(ts, '%Y-%m-%d') AS log_date, max(ts) AS ts, count(*) AS n FROM ops GROUP BY 1)
SELECT log_date, n FROM f WHERE ts < {NOW} - INTERVAL 7 DAY""")
def retention_by_age(spark, sf):
    files = op_log(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("log_date")).agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")
    )
    return cl.older_than(files, now(spark, sf), 7 * 86_400).select("log_date", "n")


@query("report_sink", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def report_sink(spark, sf):
    path = new_path(spark, "report")
    report = documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    reports.write_report(report, path)
    return spark.read.schema("lang string, n bigint, chars bigint").json(path)
