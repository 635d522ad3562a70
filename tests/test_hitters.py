"""Heavy hitters: bounds of the summary, merging, restarts, and the exact answer."""

import random
from collections import Counter
from datetime import datetime, timedelta

from answerloom.operators import warming
from answerloom.session import new_path
from answerloom.streaming import hitters
from pyspark.sql import functions as F

LOG = "key string, ts timestamp, seq bigint"


def logged(spark, keys):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + timedelta(hours=i), i) for i, k in enumerate(keys)], LOG)


def skewed(seed, n):
    rng = random.Random(seed)
    return [rng.choice([f"hot{i}" for i in range(5)]) if rng.random() < 0.6 else f"k{rng.randrange(400)}" for _ in range(n)] + [None] * 40


def test_summary_bounds_hold_over_batches(spark):
    keys = skewed(1, 900)
    log = logged(spark, keys)
    summary = hitters.Summary(spark, new_path(spark, "summary"), counters=30)
    for i in range(4):
        summary.add(log.filter(F.col("seq") % 4 == i), i)
    summary.add(log.filter("seq % 4 = 3"), 3)  # again, after a restart
    true, held, error = Counter(keys), {r.key: r.n for r in summary.keys().collect()}, summary.error()
    assert len(held) <= 30 and 0 < error <= len(keys) / 31
    for k, n in true.items():
        assert held.get(k, 0) <= n <= held.get(k, 0) + error
    assert summary._folders() == [2, 3]
    got = hitters.popular_items(log, summary, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, warming.popular_items(log, 5).collect()))
    assert {r.key for r in got.collect()} == {f"hot{i}" for i in range(5)}


def test_flat_counts_are_counted_in_full(spark):
    log = logged(spark, [f"k{i % 50}" for i in range(150)])
    summary = hitters.Summary(spark, new_path(spark, "summary"), counters=4)
    summary.add(log, 0)
    got, want = hitters.popular_items(log, summary, 3), warming.popular_items(log, 3)
    assert summary.error() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_to_count(spark):
    empty = logged(spark, ["a"]).limit(0)
    summary = hitters.Summary(spark, new_path(spark, "summary"))
    assert summary.error() == 0 and hitters.popular_items(empty, summary).count() == 0
