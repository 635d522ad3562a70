"""Online twins of the batch operators.

Event time is ``ts`` (a zoned timestamp). State per key is bounded: one expiry,
one last alert, or fewer entries than the capacity. Micro-batches bound what a
key brings at a time (``maxFilesPerTrigger`` and the like on the source).
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.entries import expires_at, micros
from ..operators.changelog import STATE
from ..operators.lifecycle import replay_step
from ..operators.lookup import cached_answer, live
from ..operators.monitor import metrics_window
from ..plans.tree import Tree
from ..schemas import LEVELS
from ..session import stage
from ..sources.snapshots import write_snapshot
from .run import run_batches, use_rocksdb

_ONE_STRING = T.StructType([T.StructField("v", T.StringType())])


def _together(rows, by: list[str]) -> pd.DataFrame:
    """This micro-batch's rows of one key in event order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


class _Expiry(StatefulProcessor):
    """Holds the writes of a key that the watermark has not settled yet.

    A set has expired if its expiry lies before the key's next write in event
    order, and is reported once the watermark is past the expiry, when no write
    before it can come any more. So neither order of arrival nor batch cuts
    change what is reported.
    """

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("writes", _ONE_STRING)

    def _settle(self, key, writes, watermark):
        """Reports and forgets what is settled; keeps the rest and a timer for the next step."""
        writes = sorted(writes)
        out, left = [], []
        for i, (at, seq, expires, level) in enumerate(writes):
            following = writes[i + 1][0] if i + 1 < len(writes) else None
            due = None if expires is None else expires // 1000 + 1
            renewed = following is not None and (expires is None or following <= expires)
            if due is not None and due <= watermark and not renewed:
                out.append((expires, level))
            elif expires is None or renewed:
                # A delete, or a set that a later write overtook: needed until nothing can come between.
                if (following if following is not None else at) // 1000 >= watermark:
                    left.append((at, seq, expires, level))
            else:
                left.append((at, seq, expires, level))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not left:
            self.state.clear()
        else:
            self.state.update((json.dumps(left),))
            steps = [t // 1000 + 1 for at, _, expires, _ in left for t in (at, expires) if t is not None]
            ahead = [t for t in steps if t > watermark]
            self.handle.registerTimer(min(ahead) if ahead else watermark + 1)
        if out:
            yield pd.DataFrame({
                "key": key[0], "level": [level for _, level in out],
                "expires_at": pd.to_datetime([e for e, _ in out], unit="us", utc=True),
            })

    def _held(self):
        return [tuple(w) for w in json.loads(self.state.get()[0])] if self.state.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        writes = set(self._held())
        for frame in rows:
            for at, seq, op, ttl, level in zip(*(frame[c].tolist() for c in ("ts_us", "seq", "operation", "ttl", "level"))):
                expires = int(at) + int(ttl) * 1_000_000 if op == "set" else None
                writes.add((int(at), int(seq), expires, level))
        yield from self._settle(key, writes, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self):
        pass


def ttl_expiry(ops: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, level, expires_at) of every set that ran out before the key's next write, once the watermark passes.

    Input: op log stream. Writes may come late by ``delay``, in any batch.
    """
    use_rocksdb(ops.sparkSession)
    slim = (
        ops.withWatermark("ts", delay)
        .filter("operation in ('set', 'delete') and key is not null")
        .select("ts", "seq", "key", "level", "operation", F.coalesce("ttl", F.lit(0)).alias("ttl"))
        .withColumn("ts_us", micros(F.col("ts")))
    )
    return slim.groupBy("key").transformWithStateInPandas(
        _Expiry(), "key string, level string, expires_at timestamp", "append", "eventTime"
    )


class _Replay(StatefulProcessor):
    def __init__(self, capacity: int, sliding: bool):
        self.step = replay_step(capacity, sliding)

    def init(self, handle):
        self.state = handle.getValueState("held", _ONE_STRING)

    def handleInputRows(self, key, rows, timerValues):
        frame = _together(rows, ["at_us", "seq"])
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        cols = {c: frame[c].tolist() for c in ("op", "key", "at_us", "ttl_us")}
        held, (outcome, evicted) = self.step(held, cols)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame({
            "cache_id": [key[0]] * len(frame), "seq": frame["seq"], "outcome": outcome,
            "evicted": pd.Series(evicted, dtype="int32"),
        })

    def close(self):
        pass


def cache_replay_stream(ops: DataFrame, capacity: int, sliding: bool = True) -> DataFrame:
    """Outcome of each op (hit, miss, set, deleted, absent) with LRU and expiry per cache."""
    use_rocksdb(ops.sparkSession)
    slim = ops.select(
        "cache_id", "key", "seq", "op", micros(F.col("ts")).alias("at_us"),
        (F.coalesce("ttl", F.lit(0)).cast("bigint") * 1_000_000).alias("ttl_us"),
    )
    return slim.groupBy("cache_id").transformWithStateInPandas(
        _Replay(capacity, sliding), "cache_id bigint, seq bigint, outcome string, evicted int", "append", "None"
    )


class _Cooldown(StatefulProcessor):
    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def init(self, handle):
        self.state = handle.getValueState("last", _ONE_STRING)

    def handleInputRows(self, key, rows, timerValues):
        frame = _together(rows, ["ts_us", "seq"])
        last = int(self.state.get()[0]) if self.state.exists() else None
        keep = []
        for at in frame["ts_us"]:
            ok = last is None or at - last >= self.cooldown_us
            last = int(at) if ok else last
            keep.append(ok)
        self.state.update((str(last),))
        kept = frame[keep]
        yield pd.DataFrame({
            "level": key[0], "category": key[1], "message": key[2], "seq": kept["seq"],
            "ts": pd.to_datetime(kept["ts_us"], unit="us", utc=True),
        })

    def close(self):
        pass


def alert_cooldown_stream(raw: DataFrame, cooldown_s: float) -> DataFrame:
    """Alerts let through, per (level, category, message)."""
    use_rocksdb(raw.sparkSession)
    slim = raw.select("level", "category", "message", "seq", micros(F.col("ts")).alias("ts_us"))
    return slim.groupBy("level", "category", "message").transformWithStateInPandas(
        _Cooldown(int(cooldown_s * 1_000_000)),
        "level string, category string, message string, seq bigint, ts timestamp", "append", "None",
    )


def metrics_stream(log: DataFrame, duration: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Closed windows only: late rows within ``delay`` still count."""
    return metrics_window(log.withWatermark("ts", delay), duration)


def access_counts_stream(
    log: DataFrame, duration: str = "24 hours", delay: str = "24 hours", slide: str | None = None,
) -> DataFrame:
    """Accesses per key and window, emitted when the window closes; ``slide``: a new window that often."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", duration, slide).alias("w"), "key")
        .agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access"))
        .select(F.col("w.start").alias("window_start"), "key", "access_count", "last_access")
    )


def semantic_lookup_stream(
    requests: DataFrame, entries: DataFrame, index: DataFrame, now, threshold: float, scope: str = "live",
    placed: Tree | None = None,
) -> DataFrame:
    """Exact-else-semantic answers for a stream of (qid, query, embedding).

    Entries and index are written out once, not worked out per batch.
    ``placed``: the index saved by :class:`~answerloom.plans.tree.Tree`; ``index`` then needs no vectors.
    """
    entries, index = stage(live(entries, now), "stream-entries"), stage(index, "stream-index")
    schema = "qid bigint, query string, source string, matched_query string, sim double, value string"

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        return cached_answer(batch, entries, index, now, threshold, scope=scope, placed=placed)

    return run_batches(requests, "lookups", work, schema).drop("batch_id")


BUCKETS = 8  # by key, to begin with; a batch rewrites those it touches
BUCKET_ROWS = 500_000
FAN = 8  # versions of a level that are merged into one of the next


def _facts(ops: DataFrame) -> DataFrame:
    """What a log says, a row per fact: value of (key, level), life of a key, clear of a level, latest time."""
    at = F.struct("ts", "seq").alias("at")
    none = F.lit(None).cast("string")
    no_time = F.lit(None).cast("timestamp")
    is_set = F.col("operation") == "set"
    writes = ops.filter("operation in ('set', 'delete')")
    values = writes.select(
        F.lit("value").alias("kind"), "key", "level", at,
        F.struct("operation", F.when(is_set, F.col("value")).alias("value"), no_time.alias("expires_at"), none.alias("ttl_level")).alias("fact"))
    lives = writes.filter("operation = 'delete' or coalesce(ttl, 0) <> 0").select(
        F.lit("life").alias("kind"), "key", none.alias("level"), at,
        F.struct("operation", none.alias("value"), F.when(is_set, expires_at(F.col("ts"), F.col("ttl"))).alias("expires_at"), F.col("level").alias("ttl_level")).alias("fact"))
    reached = F.when(F.col("level").isNull(), F.array(*[F.lit(x) for x in LEVELS])).otherwise(F.array("level"))
    nothing = F.struct(none.alias("operation"), none.alias("value"), no_time.alias("expires_at"), none.alias("ttl_level")).alias("fact")
    clears = ops.filter("operation = 'clear'").select(F.explode(reached).alias("_to"), at).select(
        F.lit("clear").alias("kind"), none.alias("key"), F.col("_to").alias("level"), "at", nothing)
    latest = ops.select(F.lit("latest").alias("kind"), none.alias("key"), none.alias("level"), at, nothing)
    return values.unionByName(lives).unionByName(clears).unionByName(latest)


def _facts_of_state(state: DataFrame) -> DataFrame:
    at = F.struct(F.col("created_at").alias("ts"), "seq").alias("at")
    none = F.lit(None).cast("string")
    values = state.select(F.lit("value").alias("kind"), "key", "level", at, F.struct(
        F.lit("set").alias("operation"), "value", F.lit(None).cast("timestamp").alias("expires_at"), none.alias("ttl_level")).alias("fact"))
    lives = state.filter("expires_at is not null").select(F.lit("life").alias("kind"), "key", none.alias("level"), at, F.struct(
        F.lit("set").alias("operation"), none.alias("value"), "expires_at", "ttl_level").alias("fact"))
    return values.unionByName(lives)


def _fold(facts: DataFrame) -> DataFrame:
    """The latest fact of each kind; order of arrival does not matter."""
    return facts.groupBy("kind", "key", "level").agg(F.max_by("fact", "at").alias("fact"), F.max("at").alias("at"))


def _state_of(facts: DataFrame) -> DataFrame:
    """State rows out of folded facts. The clears are one row per level."""
    clears = F.broadcast(facts.filter("kind = 'clear'").select(F.col("level").alias("_cleared"), F.col("at").alias("_clear_at")))

    def after_clear(rows: DataFrame, level: str) -> DataFrame:
        joined = rows.join(clears, F.col(level) == F.col("_cleared"), "left")
        return joined.filter("_clear_at is null or at > _clear_at").drop("_cleared", "_clear_at")

    values = facts.filter("kind = 'value' and fact.operation = 'set'").select(
        "key", "level", "fact.value", F.col("at.ts").alias("created_at"), "at.seq", "at")
    lives = facts.filter("kind = 'life' and fact.expires_at is not null").select(
        F.col("key").alias("_key"), "fact.expires_at", "fact.ttl_level", "at")
    kept = after_clear(values, "level").drop("at")
    lifetimes = after_clear(lives, "ttl_level").drop("at")
    return kept.join(lifetimes, F.col("key") == F.col("_key"), "left").select(*STATE)


class StateStore:
    """Folded facts under a path, in buckets that split and versions that merge.

    **Versions.** A batch writes the buckets it touches as
    ``level=0/version=<batch>/bucket=<code>``. Once FAN versions of a level are
    there, the next batch first merges them: the current contents of their
    buckets become one version of the level above, named by the newest of them,
    and then they are dropped. So n batches leave at most FAN * log(n) / log(FAN)
    folders and one more level, and a fact is rewritten once per level.

    **Buckets.** A code is a 1 and then the low bits of a key's hash, so a
    bucket is a node of a binary tree. One that has grown beyond
    ``bucket_rows`` facts is written as its two halves (or theirs), and is gone
    once a half is there; keys are dealt by the deepest code in the folders. A
    task that writes holds one bucket. The codes number facts / bucket_rows.

    What is current is read off the folders, so a restart goes on where the last
    one ended. A batch that runs again sees the versions before it and replaces
    its own; only versions before the batch are merged, and dropped only when
    the merged one is complete.
    """

    def __init__(self, start: DataFrame, path: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        if buckets & (buckets - 1) or fan < 2:
            raise ValueError("buckets must be a power of two, and fan at least 2")
        self.spark, self.start, self.path = start.sparkSession, start, path
        self.depth, self.bucket_rows, self.fan = buckets.bit_length() - 1, bucket_rows, fan
        self.schema = self._dealt(_fold(_facts_of_state(start)), set()).schema

    def _dealt(self, facts: DataFrame, split: set[int]) -> DataFrame:
        """Facts with their bucket: the shallowest code that is not split; those without a key are in bucket -1."""
        low = F.xxhash64("key")

        def code(depth: int):
            return low.bitwiseAND((1 << depth) - 1) + (1 << depth)

        deepest = max([c.bit_length() for c in split], default=self.depth)
        bucket = code(deepest)
        for depth in range(deepest - 1, self.depth - 1, -1):
            here = [c for c in split if c.bit_length() - 1 == depth]
            bucket = F.when(code(depth).isin(here), bucket).otherwise(code(depth)) if here else code(depth)
        return facts.select("kind", "key", "level", "fact", "at", F.when(F.col("key").isNull(), F.lit(-1)).otherwise(bucket).cast("bigint").alias("bucket"))

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)

    def _listed(self, path: str, name: str) -> list[int]:
        to_path, fs = self._fs()
        if not fs.exists(to_path(path)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(to_path(path))]
        return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))

    def _folder(self, level: int, version: int) -> str:
        return f"{self.path}/level={level}/version={version}"

    def versions(self, before: int | None = None) -> list[tuple[int, int]]:
        """(version, level) of complete versions, oldest first; of one batch, the merged one last."""
        to_path, fs = self._fs()
        found = []
        for level in self._listed(self.path, "level"):
            for v in self._listed(f"{self.path}/level={level}", "version"):
                if (before is None or v < before) and fs.exists(to_path(f"{self._folder(level, v)}/_SUCCESS")):
                    found.append((v, level))
        return sorted(found)

    def _held(self, versions: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Bucket -> the latest (version, level) that has it, split buckets too."""
        return {b: (v, level) for v, level in versions for b in self._listed(self._folder(level, v), "bucket")}

    def _split(self, held) -> set[int]:
        """Codes of which a half is held; a half is a 1 before the top bit's place or a 0."""
        out: set[int] = set()
        for code in held:
            while code > 0 and code.bit_length() - 1 > self.depth:
                depth = code.bit_length() - 2
                code = (code & ((1 << depth) - 1)) | (1 << depth)
                out.add(code)
        return out

    def current(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> the latest version that has it, without those that have been split."""
        held = self._held(self.versions(before))
        split = self._split(held)
        return {b: v for b, (v, _) in held.items() if b not in split}

    def _read(self, held: dict[int, tuple[int, int]]) -> DataFrame:
        inner = T.StructType([f for f in self.schema.fields if f.name != "bucket"])
        return self.spark.read.schema(inner).parquet(*[f"{self._folder(level, v)}/bucket={b}" for b, (v, level) in held.items()])

    def _bases(self, buckets) -> set[int]:
        """The buckets at the first depth that these come from."""
        low = (1 << self.depth) - 1
        return {b if b < 0 else (b & low) | (1 << self.depth) for b in buckets}

    def facts(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Current facts (of the buckets ``only``); what no version has comes from the start state."""
        held = self._held(self.versions(before))
        split = self._split(held)
        first = self._dealt(_fold(_facts_of_state(self.start)), set())
        bases = self._bases(held)
        out = first.filter(~F.col("bucket").isin(list(bases))) if bases else first
        out = self._dealt(out.drop("bucket"), split)
        if only is not None:
            out = out.filter(F.col("bucket").isin(list(only)))
        live = {b: at for b, at in held.items() if b not in split and (only is None or b in only)}
        return out.unionByName(self._dealt(self._read(live), split)) if live else out

    def _write(self, facts: DataFrame, level: int, version: int) -> None:
        (facts.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self._folder(level, version)))

    def merge(self, before: int) -> None:
        """Merges every level that has FAN versions older than ``before``, lowest first."""
        to_path, fs = self._fs()
        level = 0
        while True:
            versions = self.versions(before)
            mine = [v for v, at in versions if at == level]
            if len(mine) >= self.fan:
                held = self._held(versions)
                split = self._split(held)
                live = {b: at for b, at in held.items() if b not in split and at[1] == level}
                if live:
                    self._write(self._dealt(self._read(live), split), level + 1, mine[-1])
                for v in mine:
                    fs.delete(to_path(self._folder(level, v)), True)
            elif all(at <= level for _, at in versions):
                return
            level += 1

    def add(self, ops: DataFrame, batch_id: int, tombstones_s: float | None) -> None:
        """Writes the touched buckets of a batch as its version.

        ``tombstones_s``: deletes and clears further than that behind the latest
        time are forgotten in the buckets written; writes that come later than
        that are then undefined. None keeps them.
        """
        self.merge(batch_id)
        split = self._split(self._held(self.versions(batch_id)))
        news = stage(self._dealt(_fold(_facts(ops)), split), "stream-facts")
        touched = {r[0] for r in news.select("bucket").distinct().collect()}  # as many as there are buckets
        if not touched:
            return
        folded = _fold(self.facts(batch_id, touched).unionByName(news).drop("bucket"))
        if tombstones_s is not None:
            latest = news.filter("kind = 'latest'").agg(F.max("at.ts")).first()[0]
            old = F.col("at.ts") < F.lit(latest) - F.make_dt_interval(secs=F.lit(tombstones_s))
            folded = folded.filter(~((F.col("fact.operation") == "delete") & old) | F.col("fact.operation").isNull())
        folded = stage(folded, "stream-folded")
        dealt = self._dealt(folded, split)
        for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > self.bucket_rows) & (F.col("bucket") > 0)).collect():
            # As many halvings as bring it below the bound on average.
            codes = [r["bucket"]]
            for _ in range(math.ceil(math.log2(r["n"] / self.bucket_rows))):
                split |= set(codes)
                depth = codes[0].bit_length() - 1
                codes = [(c & ((1 << depth) - 1)) | (bit << depth) | (1 << (depth + 1)) for c in codes for bit in (0, 1)]
        self._write(self._dealt(folded, split), 0, batch_id)

    def state(self, before: int | None = None) -> DataFrame:
        return _state_of(self.facts(before))

    def latest(self):
        return self.facts(only={-1}).filter("kind = 'latest'").agg(F.max("at.ts")).first()[0]


def state_stream(
    ops: DataFrame, start: DataFrame, path: str, snapshots: str | None = None, tombstones_s: float | None = None,
) -> DataFrame:
    """Keeps the state of an op log under ``path``; returns it as it stands.

    Deletes and clears stay known, so writes may come in any order and batch.
    A batch rewrites only the buckets of the keys it has. ``snapshots``: folder
    to write a snapshot per batch to, named by the latest time seen; one of the
    same second is replaced by the newer state.
    """
    store = StateStore(start.select(*STATE), f"{path}/state")

    def work(batch: DataFrame, batch_id: int) -> None:
        store.add(stage(batch, "stream-batch"), batch_id, tombstones_s)
        if snapshots and (at := store.latest()) is not None:
            write_snapshot(store.state(), snapshots, at, force=True)

    query = (
        ops.writeStream.foreachBatch(work).option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return store.state()
