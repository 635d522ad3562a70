"""Operators on edge rows and against sequential loops."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from answerloom.functions import entries as en, text as tx, vectors as vx
from answerloom.operators import (
    answers as an, changelog as cl, evaluate as ev, lifecycle as lc, lookup as lk, monitor as mo, rules as ru,
    similarity as sm, warming as wa,
)

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def at(s):
    return T0 + dt.timedelta(seconds=s)


# ------------------------------------------------------------------- text

def normal(text):
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower()).strip())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x07FF, categories=["L", "Nd", "P", "Zs", "Cc", "Sm"]), max_size=30), min_size=30, max_size=60))
def test_normalize_is_the_python_function(spark, texts):
    # Lower-casing of a few letters differs by Unicode version between engines.
    texts = [t for t in texts if all(c.lower() == c.casefold() and len(c.lower()) == 1 for c in t) and "Σ" not in t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", tx.normalize_text(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == normal(t), repr(t)


def test_normalize_order_and_nulls(spark):
    df = spark.createDataFrame([("A  -  B",), ("",), (None,), ("é²ñ_x",)], "t string")
    got = [r[0] for r in df.select(tx.normalize_text(F.col("t"))).collect()]
    assert got == ["a  b", "", None, "é²ñ_x"]


def test_parse_size(spark):
    cases = {"2GB": 2 * 1024**3, "512 mb": 512 * 1024**2, "1.5k": 1536, "10": 10, "7B": 7, "x": None, "GB": None, "": None, "1.2.3M": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["b"] for r in df.select("s", tx.parse_size(F.col("s")).alias("b")).collect()} == cases


# ---------------------------------------------------------------- vectors

def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [round(r[0], 6) for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.96]
    back = [round(r[0], 6) for r in df.select(vx.cosine(F.col("b"), F.col("a"))).collect()]
    assert back == got


def test_unit_and_fit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<float>")
    got = [[round(x, 6) for x in r[0]] for r in df.select(vx.unit(F.col("a"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    assert [list(r[0]) for r in df.select(vx.fit(F.col("a"), 3)).collect()] == [[3.0, 4.0, 0.0], [0.0, 0.0, 0.0]]
    assert [list(r[0]) for r in df.select(vx.fit(F.col("a"), 1)).collect()] == [[3.0], [0.0]]


def test_index_keeps_latest_and_removes(spark):
    rows = [(1, "query", "What is it?", at(1), [1.0]), (2, "query", "what is it", at(2), [2.0]), (3, "result", "what is it", at(3), [0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, level string, query string, ts timestamp, embedding array<float>")
    index = sm.build_index(df, dedup=True)
    assert {r["vec_id"] for r in index.collect()} == {2, 3}
    assert sm.build_index(df).count() == 3
    left = sm.remove_from_index(index, index.filter("level = 'query'"))
    assert [r["vec_id"] for r in left.collect()] == [3]
    assert sm.clear_index(index).count() == 0
    assert {r["level"]: r["n"] for r in sm.index_counts(index).collect()} == {"query": 1, "embedding": 0, "context": 0, "result": 1}


def test_drift_edges(spark):
    rows = [("a", i, [1.0, float(i)]) for i in range(15)] + [("b", 0, [1.0, 0.0])] + [("z", 0, [0.0, 0.0]), ("z", 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "query_hash string, ts bigint, embedding array<float>")
    got = sm.drift(df, 0.0).collect()
    assert [(r["query_hash"], r["n"]) for r in got] == [("a", 10)]
    first, last = np.array([1.0, 5.0]), np.array([1.0, 14.0])
    want = 1 - first @ last / np.linalg.norm(first) / np.linalg.norm(last)
    assert abs(got[0]["drift"] - want) < 1e-5


# ----------------------------------------------------------------- lookup

@pytest.fixture(scope="module")
def stored(spark):
    rows = [
        ("a", "query", "qa", at(100)), ("a", "result", "ra", at(500)), ("b", "result", "rb", at(100)),
        ("c", "result", None, None), ("d", "result", "rd", None),
    ]
    return spark.createDataFrame(rows, "key string, level string, value string, expires_at timestamp")


def test_expiry_is_strict(spark, stored):
    flags = {(r["key"], r["level"]): r["expired"] for r in lc.ttl_status(stored, at(100)).collect()}
    assert not any(flags.values())
    assert {r["key"] for r in lc.expired_keys(stored, at(101)).collect()} == {"a", "b"}
    info = {(r["key"], r["level"]): (r["remaining_s"], r["is_expired"]) for r in lc.ttl_info(stored, at(100)).collect()}
    assert info == {("a", "query"): (0.0, True), ("a", "result"): (400.0, False), ("b", "result"): (0.0, True)}


def test_lookups(spark, stored):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "x")], "id int, key string")
    at_result = asked.withColumn("level", F.lit("result"))
    hits = {r["id"]: r["hit"] for r in lk.exact_lookup(at_result, stored, at(200)).collect()}
    assert hits == {1: True, 2: False, 3: False, 4: True, 5: False}
    # The first level holding "a" is expired, so without a level it is a miss.
    auto = {r["id"]: r["hit"] for r in lk.exact_lookup_auto(asked, stored, at(200)).collect()}
    assert auto == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert {r["id"] for r in lk.existing(asked, stored, at(200), auto=True).collect()} == {3, 4}
    assert {r["id"] for r in lk.missing(asked, stored, at(200), auto=True).collect()} == {1, 2, 5}


def test_answers_exact_semantic_miss(spark):
    entries = spark.createDataFrame(
        [("q1", "result", "r1", None), ("q2", "result", "r2", at(0)), ("q3", "result", "r3", None)],
        "key string, level string, value string, expires_at timestamp",
    )
    index = spark.createDataFrame(
        [(1, "q1", "result", [1.0, 0.0, 0.0]), (2, "q2", "result", [0.0, 1.0, 0.0]), (3, "q3", "result", [0.0, 1.0, 1.0])],
        "vec_id bigint, query string, level string, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(10, "q1", [1.0, 0.0, 0.0]), (11, "new", [0.0, 1.0, 0.1]), (12, "new", [0.0, 1.0, 0.1]), (13, "odd", [-1.0, 0.0, 0.0])],
        "qid bigint, query string, embedding array<float>",
    )

    def run(scope):
        out = lk.cached_answer(asked, entries, index, at(50), 0.6, scope=scope)
        return {r["qid"]: (r["source"], r["value"]) for r in out.collect()}

    # The nearest stored question to "new" is q2, which is dead.
    assert run("all") == {10: ("exact", "r1"), 11: ("miss", None), 12: ("miss", None), 13: ("miss", None)}
    assert run("live") == {10: ("exact", "r1"), 11: ("semantic", "r3"), 12: ("semantic", "r3"), 13: ("miss", None)}
    with pytest.raises(ValueError):
        run("some")


def test_write_back_keeps_newest(spark):
    old = spark.createDataFrame(
        [("k", "result", "old", at(5), 9, at(14))],
        "key string, level string, value string, created_at timestamp, ttl_s int, expires_at timestamp",
    )
    new = spark.createDataFrame(
        [("k", "result", "same time", None, at(5)), ("n", "result", "zero", 0, at(1)), ("n", "nowhere", "x", 0, at(1))],
        "key string, level string, value string, ttl int, ts timestamp",
    )
    got = {(r["key"], r["level"]): (r["value"], r["ttl_s"]) for r in lk.write_back(new, old).collect()}
    assert got == {("k", "result"): ("same time", 3600), ("n", "result"): ("zero", 0)}


# -------------------------------------------------------------- lifecycle

def random_log(spark, seed, n=250, caches=4, keys=9, span=4000):
    rng = random.Random(seed)
    rows = [
        (0 if rng.random() < 0.5 else rng.randrange(caches), f"k{rng.randrange(keys)}", at(rng.randrange(span)), i,
         rng.choice(["set", "get", "get", "delete"]), rng.choice([50, 400, 2000]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "cache_id bigint, key string, ts timestamp, seq bigint, op string, ttl int"), rows


def per_cache(rows):
    for cache in sorted({r[0] for r in rows}):
        yield cache, sorted((r for r in rows if r[0] == cache), key=lambda r: (r[2], r[3]))


def test_retention_is_capacity_less_one(spark):
    log, rows = random_log(spark, 1)
    for c in (2, 5, 30):
        kept = {(r["cache_id"], r["key"]) for r in lc.lru_retained(log, c).collect()}
        gone = {(r["cache_id"], r["key"]) for r in lc.lru_evicted(log, c, batch=3).collect()}
        for cache, mine in per_cache(rows):
            order = list(dict.fromkeys(r[1] for r in reversed(mine)))
            assert {k for x, k in kept if x == cache} == set(order[: c - 1])
            oldest = order[::-1][: max(0, min(3, len(order) - c + 1))]
            assert {k for x, k in gone if x == cache} == set(oldest)


@pytest.mark.parametrize("slices", [1, 6])
@pytest.mark.parametrize("sliding", [True, False])
def test_replay_equals_loop(spark, slices, sliding):
    log, rows = random_log(spark, 2)
    got = {r["seq"]: (r["outcome"], r["evicted"]) for r in lc.cache_replay(log, 4, sliding, slices).collect()}
    for _, mine in per_cache(rows):
        held = {}
        for _, key, ts, seq, op, ttl in mine:
            out, gone = None, 0
            if op == "set":
                held.pop(key, None)
                held[key] = (ts + dt.timedelta(seconds=ttl), ttl)
                out = "set"
                while len(held) > 3:
                    held.pop(next(iter(held)))
                    gone += 1
            elif op == "get":
                item = held.pop(key, None)
                out = "miss"
                if item and ts <= item[0]:
                    held[key] = (ts + dt.timedelta(seconds=item[1]), item[1]) if sliding else item
                    out = "hit"
            else:
                out = "deleted" if held.pop(key, None) else "absent"
            assert got[seq] == (out, gone)


def test_ttl_hits(spark):
    log, rows = random_log(spark, 3)
    sliding = {r["seq"]: r["hit"] for r in lc.sliding_ttl_hits(log, 300).collect()}
    fixed = {r["seq"]: r["hit"] for r in lc.fixed_ttl_hits(log, 300, slices=5).collect()}
    for _, mine in per_cache(rows):
        last, loaded = {}, {}
        for r in mine:
            key, ts = r[1], r[2]
            assert sliding[r[3]] == (key in last and (ts - last[key]).total_seconds() <= 300)
            hit = key in loaded and (ts - loaded[key]).total_seconds() <= 300
            assert fixed[r[3]] == hit
            loaded[key] = loaded[key] if hit else ts
            last[key] = ts


def test_expiry_gap_equal_is_a_hit(spark):
    log = spark.createDataFrame(
        [(1, "k", at(0), 0), (1, "k", at(300), 1), (1, "k", at(601), 2)], "cache_id bigint, key string, ts timestamp, seq bigint"
    )
    assert [r["hit"] for r in lc.sliding_ttl_hits(log, 300).orderBy("seq").collect()] == [False, True, False]
    assert [r["hit"] for r in lc.fixed_ttl_hits(log, 300).orderBy("seq").collect()] == [False, True, False]


def test_memory_forms(spark):
    sizes = spark.createDataFrame(
        [(1, at(i), i, s) for i, s in enumerate([40, 70, 30, 0, 30, 5])], "cache_id bigint, ts timestamp, seq bigint, size_bytes bigint"
    )
    prefix = [r["admitted"] for r in lc.memory_admission(sizes, 100).orderBy("seq").collect()]
    exact = [r["admitted"] for r in lc.memory_refusal(sizes, 100, slices=3).orderBy("seq").collect()]
    assert prefix == [True, False, False, False, False, False]
    assert exact == [True, False, True, True, True, False]


# -------------------------------------------------------------- changelog

def loop_state(rows):
    held, lives = {}, {}
    for ts, seq, op, key, level, value, ttl in sorted(rows, key=lambda r: (r[0], r[1])):
        if op == "set":
            held[key, level] = value
            if ttl:
                lives[key] = (ts + dt.timedelta(seconds=ttl), level)
        elif op == "delete":
            held.pop((key, level), None)
            lives.pop(key, None)
        elif op == "clear":
            held = {k: v for k, v in held.items() if level is not None and k[1] != level}
            lives = {k: v for k, v in lives.items() if level is not None and v[1] != level}
    return {(k, l): (v, lives.get(k, (None,))[0]) for (k, l), v in held.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_and_recovery(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        op = rng.choices(["set", "delete", "get", "clear"], [8, 3, 3, 0.4])[0]
        level = rng.choice(["query", "context", "result"])
        rows.append((
            at(rng.randrange(90)), i, op, None if op == "clear" else f"k{rng.randrange(8)}",
            rng.choice([level, None]) if op == "clear" else level,
            f"v{i}" if op == "set" else None, rng.choice([None, 0, 60, 600]) if op == "set" else None,
        ))
    ops = spark.createDataFrame(rows, "ts timestamp, seq bigint, operation string, key string, level string, value string, ttl int")
    want = loop_state(rows)

    def state(df):
        out = df.withColumn("e", en.micros(F.col("expires_at"))).collect()
        return {(r["key"], r["level"]): (r["value"], r["e"]) for r in out}

    def us(x):
        return None if x is None else int(x.timestamp() * 1_000_000)

    want = {k: (v, us(e)) for k, (v, e) in want.items()}
    assert state(cl.replay(ops)) == want
    cut = at(45)
    early = cl.replay(ops.filter(F.col("ts") <= F.lit(cut)))
    assert state(cl.recover(early, ops, cut)) == want


def test_retention(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 8)], "snapshot_ts string")
    assert sorted(r[0] for r in cl.keep_newest(days, 5).collect()) == ["2024-01-01", "2024-01-02"]
    files = spark.createDataFrame([("x", at(0)), ("y", at(1))], "f string, ts timestamp")
    assert [r["f"] for r in cl.older_than(files, at(86401), 86400).collect()] == ["x"]


# ------------------------------------------------------- rules and monitor

def test_rules(spark):
    versions = spark.createDataFrame(
        [("model", "result", "m1", "m2"), ("model", "context", "m1", "m2"), ("corpus", "context", "c", "c"), ("corpus", "result", None, "c")],
        "kind string, level string, stored string, current string",
    )
    got = {(r["rule_type"], r["level"], r["action"]) for r in ru.apply_rules(ru.changed_versions(versions), ru.default_rules(spark)).collect()}
    assert got == {("model_version", "result", "invalidate")}


def test_corpus_version_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    b = spark.createDataFrame([("y",), ("x",), ("y",)], "text string")
    c = spark.createDataFrame([("y",), ("x",)], "text string")
    va, vb, vc = (ru.corpus_version(d).first()[0] for d in (a, b, c))
    assert va == vb != vc


def test_stale_rules(spark):
    entries = spark.createDataFrame(
        [("old idle", at(0)), ("old used", at(0)), ("edge", at(1)), ("new", at(86_000)), ("none", None)],
        "key string, created_at timestamp",
    )
    used = spark.createDataFrame([("old used", at(86_000))], "key string, last_access timestamp")
    now = at(86_401)
    marked = ru.mark_stale(entries, used, now)
    assert {r["key"] for r in marked.filter("stale").collect()} == {"old idle", "none"}
    assert {r["key"] for r in ru.clean_stale(marked).collect()} == {"old used", "edge", "new"}
    assert ru.clean_stale(marked, limit=40.0).count() == 5
    assert ru.stale_share(marked.limit(0)).first()["goal_achieved"]


def history(spark, rates):
    rows = [(at(i * 60), float(r), 50.0, 1.0) for i, r in enumerate(rates)]
    return spark.createDataFrame(rows, "ts timestamp, cache_hit_rate double, cache_memory_usage double, memory double")


@pytest.mark.parametrize("n", [1, 9, 10, 15, 25])
def test_trend(spark, n):
    rates = [(7 * i) % 100 for i in range(n)]
    want = (sum(rates[-10:]) - sum(rates[-20:-10])) / 10 if n >= 10 else 0
    assert mo.hit_rate_trend(history(spark, rates)).first()[0] == pytest.approx(want)


def test_recommendations_need_ten_rows(spark):
    assert mo.recommendations_recent(history(spark, [10] * 9)).count() == 0
    got = mo.recommendations_recent(history(spark, [10] * 10)).collect()
    assert [(r["type"], r["value"]) for r in got] == [("hit_rate", 10.0)]


def test_alert_edges(spark):
    rows = [(at(0), 30.0, 95.0), (at(1), 29.9, 80.0), (at(2), 50.0, 79.9)]
    df = spark.createDataFrame(rows, "ts timestamp, cache_hit_rate double, cache_memory_usage double")
    got = sorted((r["level"], r["message"]) for r in mo.threshold_alerts(df).collect())
    assert got == [
        ("critical", "Cache memory usage critical: 95.0%"), ("warning", "Cache hit rate low: 29.9%"),
        ("warning", "Cache memory usage high: 80.0%"),
    ]


@pytest.mark.parametrize("slices", [1, 5])
def test_cooldown_is_greedy(spark, slices):
    rng = random.Random(5)
    rows = [(at(rng.randrange(3000)), i, "warning", "c", "hot" if rng.random() < 0.8 else "m") for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, seq bigint, level string, category string, message string")
    got = {r["seq"] for r in mo.alert_cooldown(df, 300, ("ts", "seq"), slices).collect()}
    want, last = set(), {}
    for ts, seq, *_, message in sorted(rows):
        if message not in last or (ts - last[message]).total_seconds() >= 300:
            want.add(seq)
            last[message] = ts
    assert got == want


def test_alert_window_keeps_the_edge(spark):
    df = spark.createDataFrame([(at(0), "info", "a"), (at(-1), "info", "a")], "ts timestamp, level string, category string")
    assert mo.alerts_filter(df, at(24 * 3600)).count() == 1


def test_no_requests_give_zero_rates(spark):
    none = spark.createDataFrame([], "ts timestamp, source string, dead_match boolean")
    row = mo.hit_stats(none).first()
    assert (row["requests"], row["hit_rate"], row["hit_rate_reference"]) == (0, 0.0, 0.0)


def test_reference_hit_rate_counts_probes(spark):
    rows = [(at(0), "exact", False)] * 3 + [(at(0), "semantic", False)] * 2 + [(at(0), "miss", False), (at(0), "miss", True)]
    row = mo.hit_stats(spark.createDataFrame(rows, "ts timestamp, source string, dead_match boolean")).first()
    assert row["hit_rate"] == round(500 / 7, 2)
    assert row["hit_rate_reference"] == round(100 * (3 + 4) / (3 + 6 + 1 + 2), 2)


def test_popular_ties_and_day(spark):
    rows = [("b", at(0), 0), ("a", at(1), 1), ("a", at(1 + 86_400), 2), ("b", at(86_399), 3), ("c", at(5), 4)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, seq bigint")
    got = {r["key"]: (r["access_count"], r["recent_accesses"]) for r in wa.popular_items(log, 2).collect()}
    assert got == {"a": (2, 1), "b": (2, 2)}


# --------------------------------------------------------------- evaluate

def test_metrics_with_empty_denominators(spark):
    zero = spark.createDataFrame([(0, 0, 3, 0)], "tp bigint, fp bigint, tn bigint, fn bigint")
    row = ev.classification(zero).first()
    assert (row["precision"], row["recall"], row["accuracy"], row["f1_score"]) == (0.0, 0.0, 100.0, 0.0)
    known = spark.createDataFrame([(92, 20, 80, 8)], "tp bigint, fp bigint, tn bigint, fn bigint")
    row = ev.classification(known).first()
    assert (row["precision"], row["recall"], row["accuracy"], row["f1_score"]) == (82.1, 92.0, 86.0, 0.868)
    report = ev.reuse_report(known, F.lit(0), F.lit(88.8)).first()
    assert report["cache_hit_rate"] == 56.0 and not report["all_achieved"] and report["integration_passed"]


def test_capacity_sweep_equals_simulation(spark):
    log, rows = random_log(spark, 6)
    got = {r["cache_size"]: (r["hits"], r["evictions"]) for r in ev.capacity_sweep(log, (2, 4, 20), chunk_rows=17).collect()}
    for c in (2, 4, 20):
        hits = evictions = 0
        for _, mine in per_cache(rows):
            held = {}
            for r in mine:
                hits += r[1] in held
                held.pop(r[1], None)
                held[r[1]] = 1
                while len(held) > c - 1:
                    held.pop(next(iter(held)))
                    evictions += 1
        assert got[c] == (hits, evictions)


def test_optimal_size_first_wins(spark):
    df = spark.createDataFrame([(10, 50.0, 5, 1.0), (20, 50.0, 5, 1.0)], "cache_size int, hit_rate double, evictions bigint, eviction_rate double")
    row = ev.optimal_size(df).first()
    assert (row["best_hit_rate_size"], row["lowest_evictions_size"], row["optimal_size"]) == (10, 10, 10)


# ---------------------------------------------------------------- answers

def test_model_embedder_and_answerer(spark):
    def load_model():
        return lambda texts: [[float(len(t)), 0.0, 5.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "")], "qid bigint, query string")
    got = [list(r["v"]) for r in df.select(an.model_embedder(load_model, 2)(F.col("query")).alias("v")).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0]]

    def load_answers():
        return lambda prompts: [None if "bad" in p else "text" for p in prompts]

    asked = spark.createDataFrame(
        [(1, "good", ["c0", "c1"], "good"), (2, "bad", [], "bad")], "qid bigint, query string, context array<string>, prompt string"
    )
    out = {r["qid"]: r["result"] for r in an.answer_misses(asked, an.text_answerer(load_answers)).collect()}
    assert (out[1]["answer"], out[1]["sources"], out[1]["confidence"]) == ("text", ["Doc_0", "Doc_1"], 0.9)
    assert (out[2]["answer"], out[2]["sources"], out[2]["confidence"]) == ("Error fallback answer for: bad", ["Error_Document"], 0.5)


def test_hash_embedding_depends_on_normal_text(spark):
    df = spark.createDataFrame([("What is it?",), ("what is IT!",), ("Else",), (None,)], "t string")
    v = [np.array(r[0]) for r in df.select(an.hashing_embedder(128)(F.col("t"))).collect()]
    assert v[0] @ v[1] > 0.999 and abs(v[0] @ v[2]) < 0.5
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v)


def test_quality_differs_at_ten(spark):
    df = spark.createDataFrame([("x" * 10,), ("x" * 11,), ("Mock answer for: y",), (None,)], "answer string")
    got = [(r["valid_pipeline"], r["ready_probe"]) for r in an.answer_quality(df).collect()]
    assert got == [(False, True), (True, True), (True, False), (False, False)]


def test_embeddings_are_made_once_per_hash(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["A b", "a b", "new", "new!", "a b"])], "id bigint, query string")
    known = texts.filter("id = 0").select(tx.query_hash(F.col("query")).alias("query_hash"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    out = sm.reuse_embeddings(texts, known, lambda c: F.array(F.length(c).cast("float")))
    got = {r["id"]: (r["reused"], list(r["embedding"])) for r in out.collect()}
    assert got == {0: (True, [9.0]), 1: (True, [9.0]), 4: (True, [9.0]), 2: (False, [3.0]), 3: (False, [3.0])}




def test_trend_true_mean_and_ttl_options(spark, stored):
    rates = [10.0] * 15
    df = history(spark, rates)
    assert mo.hit_rate_trend(df).first()[0] == 5.0
    assert mo.hit_rate_trend(df, true_mean=True).first()[0] == 0.0
    assert lk.live(stored, None).count() == 4
    ops = spark.createDataFrame(
        [(at(0), 0, "set", "k", "query", "v", 60)],
        "ts timestamp, seq bigint, operation string, key string, level string, value string, ttl int",
    )
    got = cl.replay(ops, ttl_anchor=at(1000)).select(en.micros(F.col("expires_at"))).first()[0]
    assert got == int(at(1060).timestamp() * 1_000_000)


def test_large_bounds_take_the_sliced_way(spark, monkeypatch):
    log, _ = random_log(spark, 7)
    pairs = spark.createDataFrame([(i, i % 2) for i in range(40)], "pair_id bigint, is_duplicate int")
    kept = {(r["cache_id"], r["key"]) for r in lc.lru_retained(log, 4).collect()}
    drawn = {(r["pair_id"], r["class_rank"]) for r in ev.sample_pairs(pairs, 7).collect()}
    monkeypatch.setattr(lc, "WINDOW_ROWS", 1)
    monkeypatch.setattr(ev, "WINDOW_ROWS", 1)
    assert {(r["cache_id"], r["key"]) for r in lc.lru_retained(log, 4).collect()} == kept
    assert {(r["pair_id"], r["class_rank"]) for r in ev.sample_pairs(pairs, 7).collect()} == drawn


def test_models_that_fail(spark):
    from answerloom.operators import answers as an

    def load():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return [[3.0, 4.0] for _ in texts]

        return model

    def broken():
        raise OSError("no model")

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "qid bigint, query string").coalesce(1)
    hashed = {r["qid"]: r["v"] for r in df.select("qid", an.hashing_embedder(80)(F.col("query")).alias("v")).collect()}
    got = {r["qid"]: r["v"] for r in df.select("qid", an.model_embedder(load, 80)(F.col("query")).alias("v")).collect()}
    assert got[1][:3] == got[3][:3] == pytest.approx([0.6, 0.8, 0.0]) and got[2] == hashed[2] and len(got[2]) == 80
    none = {r["qid"]: r["v"] for r in df.select("qid", an.model_embedder(broken, 80)(F.col("query")).alias("v")).collect()}
    assert none == hashed
    with pytest.raises(Exception):
        df.select(an.model_embedder(load, 80, fallback=False)(F.col("query"))).collect()

    def answerer():
        def model(prompts):
            if any(p == "bad" for p in prompts):
                raise ValueError("no")
            return [f"to {p}" for p in prompts]

        return model

    misses = df.filter("query is not null").withColumns({"prompt": F.col("query"), "context": F.array(F.lit("c"))})
    out = {r["qid"]: r["result"]["answer"] for r in an.answer_misses(misses, an.text_answerer(answerer)).collect()}
    assert out == {1: "to good", 2: "Error fallback answer for: bad"}


def test_hash_features_stay_in_the_engine(spark):
    from answerloom.operators import answers as an

    df = spark.range(3).select(an.hashing_embedder(96)(F.col("id").cast("string")).alias("v"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-5 for r in df.collect())


def test_questions_without_text_and_vectors(spark):
    from answerloom.operators import lookup as lk

    index = spark.createDataFrame([(1, "result", "known", [1.0, 0.0])], "vec_id bigint, level string, query string, embedding array<float>")
    entries = spark.createDataFrame([("known", "result", "value", None)], "key string, level string, value string, expires_at timestamp")
    rows = [(1, None, [1.0, 0.1]), (2, None, [0.0, 1.0]), (3, "again", None), (4, "again", [1.0, 0.0]), (5, "known", None), (6, "no vector", None)]
    asked = spark.createDataFrame(rows, "qid bigint, query string, embedding array<float>")
    got = {r["qid"]: r["source"] for r in lk.cached_answer(asked, entries, index, None, 0.9).collect()}
    assert got == {1: "semantic", 2: "miss", 3: "semantic", 4: "semantic", 5: "exact", 6: "miss"}


def test_write_back_aggregates_touched_keys_only(spark):
    from answerloom.operators import lookup as lk

    kind = "key string, level string, value string, created_at timestamp, ttl_s int, expires_at timestamp"
    t = dt.datetime(2024, 1, 1)
    store = spark.createDataFrame([("a", "result", "old", t, 5, t), ("b", "result", "kept", t, 5, t)], kind)
    fresh = spark.createDataFrame([("a", "result", "new", 7, t), ("c", "nowhere", "x", 7, t)], "key string, level string, value string, ttl int, ts timestamp")
    got = {r["key"]: (r["value"], r["ttl_s"]) for r in lk.write_back(fresh, store).collect()}
    assert got == {"a": ("new", 7), "b": ("kept", 5)}


def test_alerts_say_what_they_were_held_against(spark):
    from answerloom.operators import monitor as mo

    history = spark.createDataFrame([(dt.datetime(2024, 1, 1), 10.0, 96.5)], "ts timestamp, cache_hit_rate double, cache_memory_usage double")
    got = {r["category"]: (r["level"], r["details"]) for r in mo.threshold_alerts(history).collect()}
    assert got == {
        "memory": ("critical", {"value": "96.5", "threshold": "95.0"}), "performance": ("warning", {"value": "10.0", "threshold": "30.0"})}
    advice = {r["type"]: (r["priority"], r["action"]) for r in mo.current_recommendations(history).collect()}
    assert advice["memory_optimization"] == ("high", mo.SHRINK_CACHE) and advice["hit_rate_optimization"] == ("medium", mo.GROW_CACHE)


def test_summary_counts_everything(spark):
    from answerloom.operators import monitor as mo

    t = dt.datetime(2024, 1, 1)
    history = spark.range(1500).select(
        (F.lit(t) + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.lit(10.0).alias("cache_hit_rate"), F.lit(90.0).alias("cache_memory_usage"))
    alerts = mo.threshold_alerts(history)
    row = mo.performance_summary(history, alerts, t + dt.timedelta(seconds=1500)).first()
    assert row["total_alerts"] == 3000 and row["monitoring_duration"] == 1500
    assert mo.performance_summary(history, alerts, t, keep=100, keep_alerts=50).first()["total_alerts"] == 50
    assert tuple(mo.monitoring_stats(history, alerts).select("performance_history_size", "total_alerts").first()) == (1500, 3000)


def test_arguments_that_make_no_sense(spark):
    from answerloom.operators import lifecycle as lc
    from answerloom.sources.snapshots import write_snapshot

    log = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1), 1)], "cache_id bigint, key string, ts timestamp, seq bigint")
    for call in (
        lambda: lc.lru_retained(log, 1), lambda: lc.sliding_ttl_hits(log, -1), lambda: lc.fixed_ttl_hits(log, -1),
        lambda: lc.cache_replay(log, 0), lambda: write_snapshot(log, "nowhere", dt.datetime(2024, 1, 1), -1),
    ):
        with pytest.raises(ValueError):
            call()


def test_storing_answers_chooses_levels_and_embeds(spark):
    from answerloom.operators import answers as an, lookup as lk

    t = dt.datetime(2024, 1, 1)
    kind = "key string, level string, value string, created_at timestamp, ttl_s int, expires_at timestamp"
    store = spark.createDataFrame([("old", "result", "v", t - dt.timedelta(days=1), 5, t)], kind)
    rows = [("q1", None, '{"answer": "a"}'), ("q2", None, "short"), ("q3", None, "[1, 2]"), ("q4", None, '{"x": 1}'), ("q5", "result", "given")]
    fresh = spark.createDataFrame([(k, lv, v, None, t + dt.timedelta(seconds=i)) for i, (k, lv, v) in enumerate(rows)],
                                  "key string, level string, value string, ttl int, ts timestamp")
    entries, index = lk.store_answers(fresh, store, an.hashing_embedder(32))
    assert {r["key"]: r["level"] for r in entries.collect()} == {
        "old": "result", "q1": "result", "q2": "query", "q3": "embedding", "q4": "context", "q5": "result"}
    assert {(r["level"], r["query"]) for r in index.collect()} == {
        ("result", "q1"), ("query", "short"), ("embedding", "[1, 2]"), ("result", "q5")}
    few, _ = lk.store_answers(fresh, store, an.hashing_embedder(32), capacity=3)
    assert {r["key"] for r in few.collect()} == {"q4", "q5"}
