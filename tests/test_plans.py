"""Plan helpers against brute force on small inputs, with tiny slices and blocks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from answerloom.plans import components, fold, ordering, reuse, search

T0 = dt.datetime(2024, 1, 1)


def make_log(spark, rng, n=300, caches=3, keys=8, hot=0.5, span=5000):
    rows = []
    for i in range(n):
        cache = 0 if rng.random() < hot else rng.randrange(caches)
        rows.append((cache, f"k{rng.randrange(keys)}", T0 + dt.timedelta(seconds=rng.randrange(span)), i))
    return spark.createDataFrame(rows, "cache_id bigint, key string, ts timestamp, seq bigint"), rows


def test_rank_previous_running(spark):
    df, rows = make_log(spark, random.Random(1))
    unit = F.date_trunc("minute", "ts")
    got = ordering.rank_in_group(df, ["cache_id"], [F.col("ts"), F.col("seq")], [unit])
    got = ordering.previous_in_group(got, ["cache_id", "key"], ["rank"], "rank", F.date_trunc("minute", "ts"))
    got = ordering.running_sum(got, ["cache_id"], ["ts", "seq"], "seq", F.date_trunc("minute", "ts"))
    out = {r["seq"]: r for r in got.collect()}
    assert len(out) == len(rows)
    for cache in range(3):
        mine = sorted((r for r in rows if r[0] == cache), key=lambda r: (r[2], r[3]))
        last, total = {}, 0
        for i, r in enumerate(mine, 1):
            total += r[3]
            assert out[r[3]]["rank"] == i
            assert out[r[3]]["previous"] == last.get(r[1])
            assert out[r[3]]["running"] == total
            last[r[1]] = i


def test_rank_descending(spark):
    df, rows = make_log(spark, random.Random(2), n=80)
    got = ordering.rank_in_group(
        df, ["cache_id"], [F.col("ts").desc(), F.col("seq").desc()], [F.date_trunc("minute", "ts")], [True]
    )
    for cache in range(3):
        want = [r[3] for r in sorted((r for r in rows if r[0] == cache), key=lambda r: (r[2], r[3]), reverse=True)]
        have = [r["seq"] for r in got.filter(F.col("cache_id") == cache).orderBy("rank").collect()]
        assert have == want


def counting_fold():
    """Refuses a value when the total would pass 20; otherwise adds it."""

    def advance(state, cols):
        out = []
        for v in cols["v"]:
            if state + int(v) <= 20:
                state += int(v)
                out.append(True)
            else:
                out.append(False)
        return state, [out]

    return fold.Fold(("v",), T.StructType([T.StructField("ok", T.BooleanType())]), lambda: 0, advance)


@pytest.mark.parametrize("slices", [1, 7])
def test_ordered_fold_equals_loop(spark, slices):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.7 else rng.choice("bcd"), i, rng.randrange(6)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = {r["o"]: r["ok"] for r in fold.ordered_fold(df, ["g"], ["o"], counting_fold(), slices).collect()}
    total = {}
    for g, o, v in rows:
        ok = total.get(g, 0) + v <= 20
        total[g] = total.get(g, 0) + (v if ok else 0)
        assert got[o] == ok


@pytest.mark.parametrize("chunk", [3, 16, 1000])
def test_reuse_distance(spark, chunk):
    df, rows = make_log(spark, random.Random(4), n=200)
    got = {r["seq"]: r["distance"] for r in reuse.reuse_distance(df, chunk).collect()}
    for cache in range(3):
        mine = sorted((r for r in rows if r[0] == cache), key=lambda r: (r[2], r[3]))
        for i, r in enumerate(mine):
            before = [j for j in range(i) if mine[j][1] == r[1]]
            want = len({mine[j][1] for j in range(before[-1] + 1, i)}) if before else None
            assert got[r[3]] == want


def vectors(spark, rng, n, d=8, clusters=5, first=0, zero=True):
    centres = rng.normal(size=(clusters, d))
    m = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, d))
    m = m.astype(np.float32)
    if zero:
        m[0] = 0
    m[1] = m[2]
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>"), m.astype(np.float64)


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@pytest.mark.parametrize("threshold", [None, 0.9])
@pytest.mark.parametrize("plan", ["broadcast", "cells"])
def test_nearest(spark, plan, threshold):
    rng = np.random.default_rng(5)
    x, xm = vectors(spark, rng, 120)
    q, qm = vectors(spark, rng, 40)
    got = search.nearest(
        q, x, 5, threshold, query_id="id", index_id="id", plan=plan, cells=6, block_rows=10
    ).collect()
    have = {}
    for r in got:
        have.setdefault(r["qid"], []).append((r["rank"], r["vec_id"], round(r["sim"], 6)))
    s = np.round(unit(qm) @ unit(xm).T, 6) + 0.0
    for i in range(len(s)):
        order = sorted(range(s.shape[1]), key=lambda j: (-s[i, j], j))[:5]
        want = [(k + 1, j, s[i, j]) for k, j in enumerate(order) if threshold is None or s[i, j] >= threshold]
        assert [w[1] for w in sorted(have.get(i, []))] == [w[1] for w in want]


def test_nearest_edges(spark):
    rng = np.random.default_rng(6)
    x, _ = vectors(spark, rng, 10)
    none = x.limit(0)
    assert search.nearest(x, none, 3, query_id="id", index_id="id").count() == 0
    assert search.nearest(none, x, 3, query_id="id", index_id="id").count() == 0
    with pytest.raises(ValueError):
        search.nearest(x, x, 3, 1.5, query_id="id", index_id="id")


@pytest.mark.parametrize("threshold", [0.0, 0.9])
def test_within_keeps_every_pair_of_a_crowd(spark, threshold):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=8)
    m = np.vstack([rng.normal(size=(60, 8)), np.repeat(hot[None], 40, axis=0), hot + 0.01 * rng.normal(size=(40, 8))]).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)] + [(999, None)], "id bigint, embedding array<float>")
    got = search.within(rows, rows, threshold, query_id="id", index_id="id", cells=5, block_rows=7).collect()
    s = np.round(unit(m.astype(np.float64)) @ unit(m.astype(np.float64)).T, 6) + 0.0
    assert sorted((r.qid, r.vec_id, r.sim) for r in got) == [(i, j, s[i, j]) for i, j in zip(*np.nonzero(s >= threshold))]
    assert sum(r.qid == 60 for r in got) >= 80
    assert search.within(rows.limit(0), rows, 0.9, query_id="id", index_id="id").count() == 0
    assert search.within(rows, rows.limit(0), 0.9, query_id="id", index_id="id").count() == 0


def groups(m, t):
    s = np.round(unit(m) @ unit(m).T, 6) >= t
    label = list(range(len(m)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(s)):
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


@pytest.mark.parametrize("t", [0.8, 0.95, 0.99])
def test_similar_groups(spark, t):
    rng = np.random.default_rng(7)
    x, m = vectors(spark, rng, 90)
    edges = components.similar_edges(x, t, id_col="id", cells=5, block_rows=12)
    got = {r["id"]: r["group_id"] for r in components.connected(edges).collect()}
    for i, want in enumerate(groups(m, t)):
        assert got.get(i, i) == want


def test_connected_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "src bigint, dst bigint")
    assert {r["group_id"] for r in components.connected(edges).collect()} == {0}


def test_null_vectors_are_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])]
    x = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    for plan in ("broadcast", "cells"):
        got = search.nearest(x, x, 5, query_id="id", index_id="id", plan=plan, cells=2).collect()
        assert {(r["qid"], r["vec_id"]) for r in got} == {(0, 0), (0, 2), (2, 0), (2, 2)}


def _jobs(spark, work):
    import uuid

    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_regular_log_takes_as_many_jobs_for_any_slices(spark):
    from answerloom.operators.lifecycle import spaced_rows

    df = spark.range(2000).select(F.lit("x\x1fy").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    counts = []
    for slices in (8, 64):
        rows, jobs = _jobs(spark, lambda: spaced_rows(df, ["k"], ["ts", "id"], 300, "chosen", False, slices).filter("chosen").collect())
        assert sorted(r["id"] for r in rows) == list(range(0, 2000, 300))
        counts.append(jobs)
    assert counts[0] == counts[1]


def test_spacing_with_gaps_longer_than_slices(spark):
    import random as rnd

    from answerloom.operators.lifecycle import spaced_rows

    rng = rnd.Random(9)
    data = [(rng.choice("aab"), t, i) for i, t in enumerate(sorted(rng.randrange(3000) for _ in range(400)))]
    df = spark.createDataFrame(data, "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    for gap in (1, 37, 900):
        for strict in (False, True):
            want, last = set(), {}
            for k, t, i in data:
                if k not in last or t - last[k] > gap or (not strict and t - last[k] == gap):
                    last[k] = t
                    want.add(i)
            got = spaced_rows(df, ["k"], ["ts", "id"], gap, "chosen", strict, 11).filter("chosen").collect()
            assert {r["id"] for r in got} == want


def test_vectors_of_doubles_and_of_other_lengths(spark):
    from answerloom.plans.search import nearest
    from pyspark.errors import PythonException

    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    index = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = index.withColumnRenamed("vec_id", "qid")
    one = sorted(map(tuple, nearest(asked, index, 3, plan="broadcast").collect()))
    assert one == sorted(map(tuple, nearest(asked, index, 3, plan="cells").collect()))
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    for plan in ("broadcast", "cells"):
        with pytest.raises(PythonException):
            nearest(asked, ragged, 1, plan=plan).collect()
        with pytest.raises(PythonException):
            nearest(asked, ragged.limit(1), 1, plan=plan).collect()


def test_slices_follow_rows_not_the_calendar(spark):
    """All rows in one hour and one cache: no slice holds more than a few shares."""
    df = spark.range(4000).select(F.lit(1).alias("cache_id"), F.timestamp_millis(F.col("id")).alias("ts"), F.col("id").alias("seq"))
    sliced = ordering.row_slices(df, ["cache_id"], ["ts", "seq"])
    counts = [r["count"] for r in sliced.groupBy(ordering.SLICE).count().collect()]
    assert len(counts) >= 3 and max(counts) < 3 * 4000 / len(counts)
    ranked = ordering.rank_in_group(sliced, ["cache_id"], [F.col("ts"), F.col("seq")], [F.col(ordering.SLICE)])
    assert ranked.filter("rank <> seq + 1").count() == 0


def test_approximate_search_states_its_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.3]) for i in range(600)]
    index = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    asked = index.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    placed = search.Cells.place(search.side(index, "vec_id", "embedding", "vec_id"), cells=24)
    exact = search.nearest(asked, index, 5)
    some = search.recall(search.nearest_approximate(asked, placed, 5, 6), exact).agg(F.avg("recall")).first()[0]
    every = search.recall(search.nearest_approximate(asked, placed, 5, 99), exact).agg(F.min("recall")).first()[0]
    assert some >= 0.9 and every == 1.0
