"""Labelled evaluation, thresholds, sizes."""

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..plans.ordering import rank_in_group
from ..session import beside, stage
from . import query
from .lifecycle import DISTANCE
from .views import BEST, LOG, PAIRS, THRESHOLD, access_log, embeddings, events, pairs

T = THRESHOLD
SIZES = (5, 10, 25, 50)
SWEEP = (0.3, 0.35, 0.4, 0.65, 0.75, 0.85)


@query("pair_sample", f"""WITH {PAIRS}, d AS (SELECT pair_id, q1, q2, is_duplicate, md5(pair_id || '-42') AS draw FROM pairs)
SELECT pair_id, q1, q2, is_duplicate, draw, row_number() OVER (PARTITION BY is_duplicate ORDER BY draw, pair_id) AS class_rank
FROM d QUALIFY class_rank <= 20""")
def pair_sample(spark, sf):
    return ev.sample_pairs(pairs(spark, sf), 20)


_METRICS = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END * 100, 1) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END * 100, 1) AS recall,
  round((tp + tn) / (tp + fp + tn + fn)::DOUBLE * 100, 1) AS accuracy,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) END, 3) AS f1_score,
  round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn)::DOUBLE END * 100, 1) AS false_positive_rate"""
_COUNTS = """count(*) FILTER (is_duplicate = 1 AND {hit}) AS tp, count(*) FILTER (is_duplicate = 0 AND {hit}) AS fp,
  count(*) FILTER (is_duplicate = 0 AND NOT {hit}) AS tn, count(*) FILTER (is_duplicate = 1 AND NOT {hit}) AS fn"""


def scored(spark, sf):
    return ev.best_scores(pairs(spark, sf), embeddings(spark, sf))


def _outcomes(spark, sf):
    return scored(spark, sf).withColumn("hit", F.col("best_sim") >= T)


@query("confusion_matrix", f"WITH {BEST} SELECT {_COUNTS.format(hit=f'best_sim >= {T}')} FROM best")
def confusion_matrix(spark, sf):
    return ev.confusion(_outcomes(spark, sf))


@query("classification_metrics", f"WITH {BEST}, c AS (SELECT {_COUNTS.format(hit=f'best_sim >= {T}')} FROM best) SELECT *, {_METRICS} FROM c")
def classification_metrics(spark, sf):
    return ev.classification(ev.confusion(_outcomes(spark, sf)))


@query("threshold_sweep", f"""WITH {BEST}, t AS (SELECT unnest({list(SWEEP)}::DOUBLE[]) AS threshold),
c AS (SELECT threshold, {_COUNTS.format(hit='best_sim >= threshold')} FROM best, t GROUP BY 1) SELECT *, {_METRICS} FROM c""")
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(scored(spark, sf), SWEEP)


_LATENCY = LOG + """, lat AS (SELECT coalesce(avg(value) FILTER (op IN ('view', 'click')), 0) AS h, coalesce(avg(value) FILTER (op NOT IN ('view', 'click')), 0) AS m FROM log)"""


@query("latency_speedup", f"""WITH {_LATENCY} SELECT round(h, 4) AS avg_hit_ms, round(m, 4) AS avg_miss_ms,
  round(CASE WHEN h = 0 THEN 0 ELSE m / h END, 4) AS speedup FROM lat""")
def latency_speedup(spark, sf):
    return ev.latency(events(spark, sf).select(F.col("event_type").isin("view", "click").alias("hit"), F.col("value").alias("latency_ms")))


_REPORT = """SELECT (tp + fp + tn + fn) AS dataset_size, (tp + fp) AS cache_hits, (tn + fn) AS cache_misses,
  round(100.0::DOUBLE * (tp + fp) / (tp + fp + tn + fn), 1) AS cache_hit_rate, round(100.0::DOUBLE * (tp + fp) / (tp + fp + tn + fn), 1) AS call_reduction,
  (tp + fp) AS calls_avoided, (tp + fp + tn + fn + tn + fn) AS total_calls,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END * 100, 1) AS duplicate_hit_rate,
  round(100.0::DOUBLE * {evictions} / (tp + fp + tn + fn + tn + fn), 1) AS eviction_rate,
  (100.0::DOUBLE * (tp + fp) / (tp + fp + tn + fn) >= 60 AND {speedup} >= 10) AS all_achieved,
  (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END >= 0.7 AND (tp + fp) / (tp + fp + tn + fn)::DOUBLE >= 0.3) AS integration_passed FROM c"""


_EVICTED = """per AS (SELECT cache_id, count(*) AS requests, count(*) FILTER (distance <= {c} - 2) AS hits, count(*) FILTER (distance IS NULL) AS keys FROM dist GROUP BY 1),
gone AS (SELECT sum(requests - hits - least(keys, {c} - 1))::BIGINT AS n FROM per)"""


@query("reuse_report", f"""WITH {BEST}, {_LATENCY.replace(LOG, DISTANCE)}, {_EVICTED.format(c=50)}, c AS (SELECT {_COUNTS.format(hit='best_sim >= 0.3')} FROM best)
{_REPORT.format(evictions='(SELECT n FROM gone)', speedup='(SELECT CASE WHEN h = 0 THEN 0 ELSE m / h END FROM lat)')}""")
def reuse_report(spark, sf):
    """Evictions are those of the access log at 50 entries a cache, the speed-up that of its latencies."""
    speed = ev.latency(events(spark, sf).select(F.col("event_type").isin("view", "click").alias("hit"), F.col("value").alias("latency_ms")))
    counts = ev.confusion(scored(spark, sf).withColumn("hit", F.col("best_sim") >= 0.3))
    evicted = ev.capacity_sweep(access_log(spark, sf), (50,)).select("evictions")
    return ev.reuse_report(beside(counts, speed.select("speedup"), evicted), F.col("evictions"), F.col("speedup"))


CAPACITY = 60


@query("benchmark_replay", f"""WITH {BEST}, {_LATENCY}, kept AS (SELECT q1 FROM pairs ORDER BY md5(pair_id || '-42') DESC, pair_id DESC LIMIT {CAPACITY - 1}),
o AS (SELECT b.*, best_sim >= 0.3 AND best_id IN (SELECT q1 FROM kept) AS hit FROM best b),
c AS (SELECT {_COUNTS.format(hit='hit')} FROM o), e AS (SELECT greatest(0, count(*) - {CAPACITY - 1}) AS n FROM pairs)
SELECT c.*, r.* FROM c, ({_REPORT.format(evictions='(SELECT n FROM e)', speedup='(SELECT CASE WHEN h = 0 THEN 0 ELSE m / h END FROM lat)')}) r""")
def benchmark_replay(spark, sf):
    """Store every q1 in shuffled order, keep the last ones, look up every q2."""
    draw = F.md5(F.concat_ws("-", F.col("pair_id").cast("string"), F.lit("42")))
    shuffled = pairs(spark, sf).withColumns({"draw": draw, "_all": F.lit(0)})
    placed = rank_in_group(
        shuffled, ["_all"], [F.col("draw"), F.col("pair_id")], [F.substring("draw", 1, 3)], name="position"
    ).drop("_all", "draw")
    outcomes = ev.replay_pairs(placed, embeddings(spark, sf), 0.3, CAPACITY)
    counts = stage(ev.confusion(outcomes), "counts")  # one row, used twice
    stored = F.greatest(F.lit(0), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") - (CAPACITY - 1))
    speed = ev.latency(events(spark, sf).select(F.col("event_type").isin("view", "click").alias("hit"), F.col("value").alias("latency_ms")))
    timed = beside(counts, speed.select("speedup"))
    return beside(counts, ev.reuse_report(timed, stored, F.col("speedup")))


_SWEEP = f"""sizes AS (SELECT unnest({list(SIZES)}::INT[]) AS cache_size),
per AS (SELECT cache_id, cache_size, count(*) AS requests, count(*) FILTER (distance <= cache_size - 2) AS hits,
  count(*) FILTER (distance IS NULL) AS keys FROM dist, sizes GROUP BY 1, 2),
sweep AS (SELECT cache_size, sum(requests)::BIGINT AS requests, sum(hits)::BIGINT AS hits,
  sum(requests - hits - least(keys, cache_size - 1))::BIGINT AS evictions FROM per GROUP BY 1),
rates AS (SELECT *, round(100.0::DOUBLE * hits / requests, 2) AS hit_rate, round(100.0::DOUBLE * evictions / requests, 2) AS eviction_rate FROM sweep)"""


@query("capacity_sweep", f"WITH {DISTANCE}, {_SWEEP} SELECT * FROM rates")
def capacity_sweep(spark, sf):
    return ev.capacity_sweep(access_log(spark, sf), SIZES)


@query("optimal_size", f"""WITH {DISTANCE}, {_SWEEP}
SELECT arg_max(cache_size, (hit_rate, -cache_size)) AS best_hit_rate_size, arg_min(cache_size, (evictions, cache_size)) AS lowest_evictions_size,
  arg_max(cache_size, (round(hit_rate - 0.1::DOUBLE * eviction_rate, 6), -cache_size)) AS optimal_size,
  round(max(hit_rate - 0.1::DOUBLE * eviction_rate), 4) AS optimal_score,
  round(arg_max(cache_size, (round(hit_rate - 0.1::DOUBLE * eviction_rate, 6), -cache_size)) * 3 / 1024.0::DOUBLE, 4) AS memory_mb FROM rates""")
def optimal_size(spark, sf):
    return ev.optimal_size(ev.capacity_sweep(access_log(spark, sf), SIZES))
