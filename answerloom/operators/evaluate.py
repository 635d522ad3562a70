"""Was reuse right, and what did it save: labelled pairs, sizes, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.entries import percent, ratio
from ..plans.ordering import rank_in_group
from ..plans.reuse import reuse_distance
from ..plans.search import nearest
from .lifecycle import WINDOW_ROWS, lru_retained

# Goals of a run.
HIT_GOAL, SAVED_GOAL, SPEEDUP_GOAL = 60, 40, 10
DUPLICATE_HIT_GOAL, OVERALL_HIT_GOAL = 0.7, 0.3


def sample_pairs(pairs: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """``per_class`` pairs of each class in hash order, with a shuffle position.

    Hash order replaces a random draw: the same rows on any engine. The bound
    is a parameter, so the window's group limit trims before the shuffle; a
    large one goes by ranks sliced along the hash.
    """
    draw = F.md5(F.concat_ws("-", F.col("pair_id").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("is_duplicate").orderBy("draw", "pair_id")
    drawn = pairs.filter(F.col("is_duplicate").isin(0, 1)).withColumn("draw", draw)
    if per_class > WINDOW_ROWS:
        order = [F.col("draw"), F.col("pair_id")]
        ranked = rank_in_group(drawn, ["is_duplicate"], order, [F.substring("draw", 1, 3)], name="class_rank")
    else:
        ranked = drawn.withColumn("class_rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("class_rank") <= per_class)


def best_scores(pairs: DataFrame, vectors: DataFrame, **search) -> DataFrame:
    """Pairs with ``best_sim`` and ``best_id``: q2 against every q1.

    ``pairs``: (pair_id, q1, q2, is_duplicate); ``vectors``: (vec_id, embedding).
    """
    v = vectors.select("vec_id", "embedding")
    stored = v.join(pairs.select(F.col("q1").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = v.join(pairs.select(F.col("q2").alias("vec_id")).distinct(), "vec_id", "left_semi")
    best = nearest(asked, stored, 1, None, query_id="vec_id", **search)
    return pairs.join(
        best.select(F.col("qid").alias("q2"), F.col("vec_id").alias("best_id"), F.col("sim").alias("best_sim")), "q2", "left"
    )


def confusion(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts from (is_duplicate, hit); a miss on a duplicate is a false negative."""
    dup, hit = F.col("is_duplicate") == 1, F.col("hit")
    return outcomes.groupBy(*by).agg(
        F.count_if(dup & hit).alias("tp"), F.count_if(~dup & hit).alias("fp"),
        F.count_if(~dup & ~hit).alias("tn"), F.count_if(dup & ~hit).alias("fn"),
    )


def classification(counts: DataFrame) -> DataFrame:
    """Precision, recall, accuracy, F1, false positive rate; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": F.round(precision * 100, 1),
        "recall": F.round(recall * 100, 1),
        "accuracy": F.round(ratio(tp + tn, tp + fp + tn + fn) * 100, 1),
        "f1_score": F.round(ratio(2 * precision * recall, precision + recall), 3),
        "false_positive_rate": F.round(ratio(fp, fp + tn) * 100, 1),
    })


def latency(requests: DataFrame, ms: str = "latency_ms") -> DataFrame:
    hit = F.avg(F.when(F.col("hit"), F.col(ms)))
    miss = F.avg(F.when(~F.col("hit"), F.col(ms)))
    return requests.agg(
        F.coalesce(hit, F.lit(0.0)).alias("h"), F.coalesce(miss, F.lit(0.0)).alias("m")
    ).select(
        F.round("h", 4).alias("avg_hit_ms"), F.round("m", 4).alias("avg_miss_ms"),
        F.round(ratio(F.col("m"), F.col("h")), 4).alias("speedup"),
    )


def reuse_report(counts: DataFrame, evictions, speedup) -> DataFrame:
    """Savings from confusion counts; ``evictions`` and ``speedup`` are columns of ``counts`` or literals."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pairs, hits, dups = tp + fp + tn + fn, tp + fp, tp + fn
    hit_rate = percent(hits, pairs)
    duplicate_rate = ratio(tp, dups)
    return counts.select(
        pairs.alias("dataset_size"), hits.alias("cache_hits"), (tn + fn).alias("cache_misses"),
        F.round(hit_rate, 1).alias("cache_hit_rate"), F.round(hit_rate, 1).alias("call_reduction"),
        hits.alias("calls_avoided"), (pairs + tn + fn).alias("total_calls"),
        F.round(duplicate_rate * 100, 1).alias("duplicate_hit_rate"),
        F.round(percent(evictions, pairs + tn + fn), 1).alias("eviction_rate"),
        ((hit_rate >= HIT_GOAL) & (hit_rate >= SAVED_GOAL) & (speedup >= SPEEDUP_GOAL)).alias("all_achieved"),
        ((duplicate_rate >= DUPLICATE_HIT_GOAL) & (hit_rate / 100 >= OVERALL_HIT_GOAL)).alias("integration_passed"),
    )


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion and metrics for every threshold in one pass over the best scores."""
    # Scores are grouped first; thresholds multiply the distinct scores, not the pairs.
    grouped = scored.groupBy("is_duplicate", "best_sim").agg(F.count(F.lit(1)).alias("n"))
    each = grouped.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    dup = F.col("is_duplicate") == 1
    hit = F.coalesce(F.col("best_sim") >= F.col("threshold"), F.lit(False))

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    counts = each.groupBy("threshold").agg(
        total(dup & hit).alias("tp"), total(~dup & hit).alias("fp"),
        total(~dup & ~hit).alias("tn"), total(dup & ~hit).alias("fn"),
    )
    return classification(counts)


def capacity_sweep(log: DataFrame, sizes: Sequence[int], **reuse) -> DataFrame:
    """Hits, evictions and rates of an LRU for every size, from one reuse-distance pass.

    Capacity C holds C - 1 keys, so an access hits iff at most C - 2 distinct
    keys came between.
    """
    distances = reuse_distance(log, **reuse).groupBy("cache_id", "distance").agg(F.count(F.lit(1)).alias("n"))
    size = F.explode(F.array(*[F.lit(int(c)) for c in sizes])).alias("cache_size")
    hit = F.col("distance") <= F.col("cache_size") - 2
    per_cache = (
        distances.select("*", size).groupBy("cache_id", "cache_size")
        .agg(
            F.sum("n").alias("requests"),
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hits"),
            F.coalesce(F.sum(F.when(F.col("distance").isNull(), F.col("n"))), F.lit(0)).alias("keys"),
        )
    )
    kept = F.least(F.col("keys"), F.col("cache_size") - 1)
    return (
        per_cache.withColumn("evictions", F.col("requests") - F.col("hits") - kept)
        .groupBy("cache_size")
        .agg(
            F.sum("requests").cast("bigint").alias("requests"), F.sum("hits").cast("bigint").alias("hits"),
            F.sum("evictions").cast("bigint").alias("evictions"),
        )
        .withColumns({
            "hit_rate": percent(F.col("hits"), F.col("requests"), 2),
            "eviction_rate": percent(F.col("evictions"), F.col("requests"), 2),
        })
    )


def optimal_size(sweep: DataFrame) -> DataFrame:
    """Best by hit rate, fewest evictions, and by their balance; first (smallest) wins ties."""
    first = -F.col("cache_size")
    score = F.col("hit_rate") - 0.1 * F.col("eviction_rate")
    best = sweep.agg(
        F.max_by("cache_size", F.struct(F.col("hit_rate"), first)).alias("best_hit_rate_size"),
        F.max_by("cache_size", F.struct(-F.col("evictions"), first)).alias("lowest_evictions_size"),
        F.max_by("cache_size", F.struct(F.round(score, 6), first)).alias("optimal_size"),
        F.round(F.max(score), 4).alias("optimal_score"),
    )
    return best.withColumn("memory_mb", F.round(F.col("optimal_size") * 3 / 1024, 4))


def replay_pairs(pairs: DataFrame, vectors: DataFrame, threshold: float, capacity: int, **search) -> DataFrame:
    """Outcomes of: store every q1 in order, keep the last C - 1, then look up every q2.

    The index holds every q1, kept or not; a best match that is no longer kept
    is a miss.
    """
    writes = pairs.select(
        F.lit(0).alias("cache_id"), F.col("q1").alias("key"),
        F.timestamp_seconds(F.col("position")).alias("ts"), F.col("position").alias("seq"),
    )
    kept = lru_retained(writes, capacity).select(F.col("key").alias("best_id"), F.lit(True).alias("kept"))
    scored = best_scores(pairs, vectors, **search)
    hit = (F.col("best_sim") >= threshold) & F.col("kept")
    return scored.join(kept, "best_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
