"""Files in and out, and streams against their batch twins."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import changelog as cl, lifecycle as lc, monitor as mo
from answerloom.session import new_path
from answerloom.sources import corpus as co, oplog, pairs, reports, snapshots as sn
from answerloom.streaming import jobs
from answerloom.streaming.run import run_to_parquet

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_pairs_csv(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('id,qid1,qid2,question1,question2,is_duplicate\n1,1,2,"Say ""hi""\nnow?","b, c",1\n0,3,4,x,y,0\n2,5,6,z,,\n')
    got = pairs.first_rows(pairs.valid_pairs(pairs.read_pairs_csv(spark, str(path))), 1).collect()
    assert [(r["id"], r["question1"]) for r in got] == [(0, "x")]
    assert pairs.read_pairs_csv(spark, str(path)).filter("id = 1").first()["question1"] == 'Say "hi"\nnow?'


OPS = "ts timestamp, seq bigint, operation string, key string, level string, value string, ttl int"


def test_log_files(spark):
    rows = [(at(0), 0, "set", "a", "query", "v", 5), (at(90_000), 1, "get", "a", "query", "dropped", 7), (at(90_001), 2, "clear", None, None, None, None)]
    path = new_path(spark, "log")
    oplog.append_log(spark.createDataFrame(rows, OPS), path)
    day = os.path.join(path.replace("file:", ""), "log_date=2024-01-02")
    with open(os.path.join(day, "more.json"), "w") as f:
        f.write("{broken\n")
    got = {r["seq"]: r for r in oplog.read_log(spark, path).collect()}
    assert set(got) == {0, 1, 2} and got[1]["value"] is None and got[0]["ttl"] == 5
    assert {r["seq"] for r in oplog.read_log(spark, path, at(90_000)).collect()} == {2}
    plan = oplog.read_log(spark, path, at(90_000))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_snapshots(spark):
    path = new_path(spark, "snap")
    df = spark.createDataFrame([(1, [1.0])], "k bigint, v array<float>")
    assert sn.read_snapshot(spark, path, df.schema).count() == 0
    assert sn.snapshot_info(spark, path).count() == 0
    t = dt.datetime(2024, 1, 1)
    assert sn.write_snapshot(df, path, t)
    assert not sn.write_snapshot(df, path, t + dt.timedelta(seconds=10), min_interval_s=60)
    assert sn.write_snapshot(df.union(df), path, t + dt.timedelta(seconds=10), min_interval_s=60, force=True)
    assert sn.read_snapshot(spark, path, df.schema).count() == 2
    assert sn.read_snapshot(spark, path, df.schema, "20240101_000000").count() == 1
    assert sn.read_snapshot(spark, path, df.schema, "19990101_000000").count() == 0
    names = [r["snapshot_ts"] for r in sn.snapshot_info(spark, path).collect()]
    assert names == ["20240101_000010", "20240101_000000"]
    reports.write_report(df, path + "-report")
    assert spark.read.json(path + "-report").count() == 1


def test_page_selection(spark):
    html = (
        '<body><p>no</p><div class="post-title big">T<br>itle</div>'
        '<div class="post-content"><p>a &amp; b<div class="post-header">in</div></p><script>x</script></div><p>no</p></body>'
    )
    df = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in co.select_page_text(df).collect()}
    assert got == {1: "Titlea & bin", 2: ""}


def test_fixed_chunks_reassemble(spark):
    texts = ["", "x" * 5, "".join(chr(97 + i % 26) for i in range(103)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = co.chunk_fixed(df, 20, 5).orderBy("doc_id", "chunk_no").collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r["doc_id"] == i]
        built = ""
        for r in mine:
            assert len(r["text"]) <= 20
            built = built[: r["start"]] + r["text"]
        assert built == (t or "")
    with pytest.raises(ValueError):
        co.chunk_fixed(df, 5, 5)


def test_recursive_chunks():
    rng = random.Random(1)
    words = [f"{i}{'w' * rng.randrange(1, 9)}" for i in range(300)]
    text = "".join(w + rng.choice([" ", " ", "\n", "\n\n"]) for w in words) + "".join(map(chr, range(200, 330)))
    chunks = list(co.split_text(text, 50, 12))
    assert all(len(c) <= 50 for c in chunks)
    # Every chunk is a piece of the text, they come in order, and nothing is lost.
    where, end = -1, 0
    for c in chunks:
        where = text.index(c, max(0, where))
        assert where <= end
        end = max(end, where + len(c))
    assert end == len(text)
    assert list(co.split_text("short", 50, 12)) == ["short"]


def streamed(spark, df, files=3):
    path = new_path(spark, "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_replay_over_several_batches(spark):
    """Batches in event order give what one batch gives."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), f"k{rng.randrange(6)}", at(i * 7), i, rng.choice(["set", "get", "delete"]), 60) for i in range(120)]
    df = spark.createDataFrame(rows, "cache_id bigint, key string, ts timestamp, seq bigint, op string, ttl int")
    path = new_path(spark, "in")
    for a in range(0, 120, 40):
        df.filter(F.col("seq").between(a, a + 39)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_to_parquet(jobs.cache_replay_stream(source, 4), "replay")
    want = lc.cache_replay(df, 4, slices=3)
    key = ["cache_id", "seq", "outcome", "evicted"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_stream_metrics_equal_closed_windows(spark):
    rows = [(1, "k", at(i * 30), i, bool(i % 3), not i % 3, False, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "cache_id bigint, key string, ts timestamp, seq bigint, is_hit boolean, is_miss boolean, is_set boolean, value double")
    got = run_to_parquet(jobs.metrics_stream(streamed(spark, df), "5 minutes", "1 minute"), "metrics")
    want = {tuple(r) for r in mo.metrics_window(df, "5 minutes").collect()}
    have = {tuple(r) for r in got.collect()}
    assert have <= want and len(have) >= len(want) - 2


def test_stream_state_with_snapshots(spark):
    rng = random.Random(3)
    rows = [(at(i), i, rng.choice(["set", "set", "delete"]), f"k{rng.randrange(5)}", "query", f"v{i}", 50) for i in range(60)]
    ops = spark.createDataFrame(rows, OPS)
    path, snaps = new_path(spark, "in"), new_path(spark, "snaps")
    for a in (0, 20, 40):
        ops.filter(F.col("seq").between(a, a + 19)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(path)
    want = cl.replay(ops)
    last = jobs.state_stream(source, cl.replay(ops.limit(0)), new_path(spark, "versions"), snaps)
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect()))
    assert sn.read_snapshot(spark, snaps, last.schema).count() == want.count()
    assert sn.snapshot_info(spark, snaps).count() == 3


def test_stream_expiry_is_replaced_and_dropped(spark):
    rows = [
        (at(0), 0, "set", "early", "query", "v", 10), (at(0), 1, "set", "kept", "query", "v", 10),
        (at(5), 2, "set", "kept", "result", "v", 10_000), (at(0), 3, "set", "gone", "query", "v", 10),
        (at(6), 4, "delete", "gone", "query", None, None), (at(500), 5, "set", "last", "query", "v", 1),
    ]
    ops = spark.createDataFrame(rows, OPS)
    got = run_to_parquet(jobs.ttl_expiry(streamed(spark, ops, 1)), "expired").collect()
    assert [(r["key"], r["level"]) for r in got] == [("early", "query")]


def in_batches(spark, ops, batches):
    """A stream whose micro-batches hold the rows with these seq values, in this order."""
    path = new_path(spark, "in")
    for batch in batches:
        ops.filter(F.col("seq").isin(batch)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stream_state_in_any_order(spark):
    """Late sets, deletes and clears, over several batches, give the batch replay."""
    rng = random.Random(12)
    for seed in range(3):
        kinds = ["set", "set", "set", "delete", "clear"]
        rows = []
        for i in range(60):
            op = rng.choice(kinds)
            level = rng.choice(["query", "result", None]) if op == "clear" else rng.choice(["query", "result"])
            rows.append((at(rng.randrange(50)), i, op, None if op == "clear" else f"k{rng.randrange(6)}", level, f"v{i}", rng.choice([None, 0, 50])))
        ops = spark.createDataFrame(rows, OPS)
        order = list(range(60))
        rng.shuffle(order)
        source = in_batches(spark, ops, [order[a:a + 15] for a in range(0, 60, 15)])
        got = jobs.state_stream(source, cl.replay(ops.limit(0)), new_path(spark, "versions"))
        assert rows_of(got) == rows_of(cl.replay(ops))


def test_stream_state_after_restart_and_with_start_state(spark):
    rows = [(at(i), i, "set", f"k{i}", "query", f"v{i}", 50) for i in range(6)] + [(at(9), 9, "delete", "k1", "query", None, None)]
    ops = spark.createDataFrame(rows, OPS)
    start = cl.replay(ops.filter("seq < 2"))
    path, into = new_path(spark, "versions"), new_path(spark, "in")
    ops.filter("seq in (2, 3)").coalesce(1).write.parquet(into)

    def run():
        return jobs.state_stream(spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(into), start, path)

    first = rows_of(run())
    assert first == rows_of(cl.replay(ops.filter("seq < 4")))
    assert rows_of(run()) == first  # nothing new: the state stays
    ops.filter("seq in (4, 5, 9)").coalesce(1).write.mode("append").parquet(into)
    assert rows_of(run()) == rows_of(cl.replay(ops))


def test_a_repeated_batch_replaces_itself_and_touches_few_buckets(spark):
    ops = spark.createDataFrame([(at(i), i, "set", f"k{i}", "query", "v", 50) for i in range(40)], OPS)
    store = jobs.StateStore(cl.replay(ops.limit(0)), new_path(spark, "state"))
    store.add(ops.filter("seq < 38"), 0, None)
    store.add(ops.filter("seq = 38"), 1, None)
    store.add(ops.filter("seq = 39"), 1, None)
    assert rows_of(store.state()) == rows_of(cl.replay(ops.filter("seq <> 38")))
    assert sum(v == 1 for v in store.current().values()) == 2  # the key's bucket and the one for all keys


def test_versions_merge_in_levels(spark):
    rng = random.Random(2)
    rows = [(at(i), i, rng.choice(["set", "set", "delete"]), f"k{rng.randrange(9)}", "query", f"v{i}", 50) for i in range(11)]
    ops = spark.createDataFrame(rows, OPS)
    store = jobs.StateStore(cl.replay(ops.limit(0)), new_path(spark, "state"), buckets=4, fan=3)
    most = 0
    for i in range(11):
        store.add(ops.filter(f"seq = {i}"), i, None)
        most = max(most, len(store.versions()))
    # Eleven batches: at most three versions in each of three levels, and higher levels are in use.
    assert most <= 6 and {level for _, level in store.versions()} >= {0, 2}
    assert rows_of(store.state()) == rows_of(cl.replay(ops))
    store.add(ops.filter("seq = 10"), 10, None)  # again, after a restart
    assert rows_of(store.state()) == rows_of(cl.replay(ops))


def test_crowded_buckets_split(spark):
    rows = [(at(i), i, "set", f"k{i % 150}", "query", f"v{i}", 50) for i in range(300)] + [(at(400), 400, "delete", "k3", "query", None, None)]
    ops = spark.createDataFrame(rows, OPS)
    start = cl.replay(ops.filter("seq < 100"))
    store = jobs.StateStore(start, new_path(spark, "state"), buckets=2, bucket_rows=40)
    store.add(ops.filter("seq between 100 and 120"), 0, None)
    assert {b.bit_length() - 1 for b in store.current() if b > 0} != {1}
    store.add(ops.filter("seq between 121 and 299"), 1, None)
    store.add(ops.filter("seq = 400"), 2, None)
    assert rows_of(store.state()) == rows_of(cl.replay(ops))
    sizes = [r["count"] for r in store.facts().filter("bucket > 0").groupBy("bucket").count().collect()]
    assert max(sizes) <= 80 and len(sizes) >= 6
    again = jobs.StateStore(start, store.path, buckets=2, bucket_rows=40)
    assert rows_of(again.state()) == rows_of(cl.replay(ops))


def test_old_tombstones_can_be_forgotten(spark):
    rows = [(at(0), 0, "set", "a", "query", "v", 50), (at(1), 1, "delete", "a", "query", None, None), (at(1000), 2, "set", "a", "result", "w", 50)]
    ops = spark.createDataFrame(rows, OPS)
    got = jobs.state_stream(in_batches(spark, ops, [[0, 1], [2]]), cl.replay(ops.limit(0)), new_path(spark, "versions"), tombstones_s=60)
    assert [(r["key"], r["level"]) for r in got.collect()] == [("a", "result")]


def test_snapshots_of_one_second_replace_each_other(spark):
    ops = spark.createDataFrame([(at(0.2 * i), i, "set", f"k{i}", "query", "v", 50) for i in range(4)], OPS)
    snaps = new_path(spark, "snaps")
    state = jobs.state_stream(in_batches(spark, ops, [[0, 1], [3], [2]]), cl.replay(ops.limit(0)), new_path(spark, "versions"), snaps)
    assert sn.read_snapshot(spark, snaps, state.schema).count() == 4 and sn.snapshot_info(spark, snaps).count() == 1


def expired(spark, ops, batches, delay):
    got = run_to_parquet(jobs.ttl_expiry(in_batches(spark, ops, batches), delay), "expired").collect()
    return sorted((r["key"], (r["expires_at"].replace(tzinfo=UTC) - T0).total_seconds()) for r in got)


def test_late_sets_do_not_shorten_a_life(spark):
    rows = [(at(100), 0, "set", "a", "query", "v", 1000), (at(50), 1, "set", "a", "query", "v", 100), (at(400), 2, "set", "z", "query", "v", 9999)]
    assert expired(spark, spark.createDataFrame(rows, OPS), [[0], [1], [2]], "100 seconds") == []


def test_expiry_does_not_depend_on_batch_cuts(spark):
    rng = random.Random(4)
    rows = [(at(10 * i), i, rng.choice(["set", "set", "delete"]), f"k{rng.randrange(4)}", "query", "v", rng.choice([15, 60, 400])) for i in range(60)]
    rows += [(at(5000), 60, "set", "end", "query", "v", 1)]
    ops = spark.createDataFrame(rows, OPS)
    want = []
    for key in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == key]
        for r, following in zip(own, [*own[1:], None]):
            end = (r[0] - T0).total_seconds() + (r[6] if r[2] == "set" else 0)
            if r[2] == "set" and end < 5000 - 60 and (following is None or end < (following[0] - T0).total_seconds()):
                want.append((key, end))
    swapped = [i ^ 1 for i in range(60)]
    for cuts in ([list(range(61))], [swapped[:20], swapped[20:41], swapped[41:], [60]], [[i] for i in swapped[:6]] + [swapped[6:], [60]]):
        assert expired(spark, ops, cuts, "60 seconds") == sorted(want)


def test_recursive_chunks_leave_in_small_batches(spark, monkeypatch):
    from answerloom.sources import corpus

    rows = [(i, f"para {i}\n\n" + "word " * 400 + "\n" + "line " * 300) for i in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    plain = [(i, n, c) for i, t in rows for n, c in enumerate(c for c in (c.strip() for c in corpus.split_text(t or "", 500, 100)) if c)]
    monkeypatch.setattr(corpus, "CHARS_HELD", 2_000)
    assert [tuple(r) for r in corpus.chunk_recursive(docs, 500, 100).collect()] == plain
    made = list(corpus._chunk_rows(plain[:3]).to_pylist())
    assert [tuple(r.values()) for r in made] == plain[:3]
