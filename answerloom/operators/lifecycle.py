"""How long entries live and which stay: lifetimes, recency, retention, replay.

Access logs: (cache_id, key, ts, seq, ...), ordered by (ts, seq) per cache.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.entries import is_expired, micros, percent, ttl_for, expires_at
from ..plans.fold import Fold, ordered_fold
from ..plans.ordering import SLICE, previous_in_group, rank_in_group, row_slices, running_sum
from ..session import stage


WINDOW_ROWS = 100_000  # most rows per group a plain window may gather


def _at_least(name: str, value: float, least: float) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")


def assign_ttl(entries: DataFrame, scale: int = 1) -> DataFrame:
    """``ttl_s`` (own or by level) and ``expires_at`` from ``created_at``."""
    ttl = ttl_for(F.col("level"), F.col("ttl"), scale)
    return entries.withColumn("ttl_s", ttl).withColumn(
        "expires_at", expires_at(F.col("created_at"), F.col("ttl_s"))
    )


def ttl_status(entries: DataFrame, now) -> DataFrame:
    return entries.withColumn("expired", is_expired(F.col("expires_at"), now))


def expired_keys(entries: DataFrame, now) -> DataFrame:
    return entries.filter(F.lit(now) > F.col("expires_at"))


def ttl_info(entries: DataFrame, now) -> DataFrame:
    """Remaining seconds; here an entry at its very expiry already counts as expired."""
    left = (micros(F.col("expires_at")) - micros(F.lit(now))) / 1e6
    return (
        entries.filter(F.col("expires_at").isNotNull())
        .withColumn("remaining_s", F.greatest(F.lit(0.0), left))
        .withColumn("is_expired", F.col("remaining_s") <= 0)
    )


def ttl_stats(entries: DataFrame, now) -> DataFrame:
    expired = is_expired(F.col("expires_at"), now)
    return entries.filter(F.col("expires_at").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.count_if(~expired).alias("active_keys"),
        F.count_if(expired).alias("expired_keys"),
        F.round(F.coalesce(F.avg("ttl_s"), F.lit(0.0)), 2).alias("average_ttl"),
    )


def delete_keys(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    """Drops (key, level) pairs; a delete without a level drops the key everywhere."""
    some = deletes.filter("level is not null").select("key", "level").distinct()
    whole = deletes.filter("level is null").select("key").distinct()
    return entries.join(some, ["key", "level"], "left_anti").join(whole, "key", "left_anti")


def access_counts(log: DataFrame, group=("cache_id", "key")) -> DataFrame:
    return log.groupBy(*group).agg(
        F.count(F.lit(1)).alias("access_count"),
        F.min("ts").alias("first_access"), F.max("ts").alias("last_access"),
    )


def _touched(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("cache_id", "key")
        .agg(F.max(F.struct("ts", "seq")).alias("last"), F.count(F.lit(1)).alias("access_count"))
        .select("cache_id", "key", F.col("last.ts").alias("last_access"), F.col("last.seq").alias("last_seq"), "access_count")
    )


def _ranked(log: DataFrame, order: list[str], name: str, descending: bool = False) -> DataFrame:
    sliced = row_slices(_touched(log), ["cache_id"], order)
    by = [F.col(c).desc() if descending else F.col(c) for c in order]
    return rank_in_group(sliced, ["cache_id"], by, [F.col(SLICE)], [descending], name).drop(SLICE)


def lru_order(log: DataFrame) -> DataFrame:
    """``lru_rank`` 1 = least recently used, per cache."""
    return _ranked(log, ["last_access", "last_seq"], "lru_rank")


def mru_order(log: DataFrame) -> DataFrame:
    return _ranked(log, ["last_access", "last_seq"], "mru_rank", descending=True)


def lfu_order(log: DataFrame) -> DataFrame:
    """``lfu_rank`` 1 = least often used; ties by recency."""
    return _ranked(log, ["access_count", "last_access", "last_seq"], "lfu_rank")


def lru_retained(log: DataFrame, capacity: int) -> DataFrame:
    """Keys still held: the last ``capacity - 1`` distinct keys of each cache.

    The bound is a parameter, so every map task passes on that many rows at most;
    a large bound goes by sliced ranks, which gather it in no single task.
    """
    _at_least("capacity", capacity, 2)
    if capacity > WINDOW_ROWS:
        return mru_order(log).filter(F.col("mru_rank") <= capacity - 1)
    w = Window.partitionBy("cache_id").orderBy(F.col("last_access").desc(), F.col("last_seq").desc())
    return _touched(log).withColumn("mru_rank", F.row_number().over(w).cast("bigint")).filter(F.col("mru_rank") <= capacity - 1)


def lru_sample(log: DataFrame, n: int = 10) -> DataFrame:
    """Tracked keys per cache and, on a row each, the ``n`` least recently used."""
    touched = stage(_touched(log))
    w = Window.partitionBy("cache_id").orderBy("last_access", "last_seq")
    oldest = touched.withColumn("lru_rank", F.row_number().over(w)).filter(F.col("lru_rank") <= n)
    counts = touched.groupBy("cache_id").agg(F.count(F.lit(1)).alias("total_tracked_keys"))
    return oldest.join(counts, "cache_id").select("cache_id", "total_tracked_keys", "lru_rank", "key")


def lru_evicted(log: DataFrame, capacity: int, batch: int = 10) -> DataFrame:
    """Keys one eviction pass drops: the oldest ``min(overflow, batch)`` of each cache."""
    touched = _touched(log)
    w = Window.partitionBy("cache_id").orderBy("last_access", "last_seq")
    oldest = touched.withColumn("lru_rank", F.row_number().over(w)).filter(F.col("lru_rank") <= batch)
    overflow = touched.groupBy("cache_id").agg((F.count(F.lit(1)) - capacity + 1).alias("overflow"))
    return oldest.join(overflow, "cache_id").filter("lru_rank <= overflow").drop("overflow")


def memory_admission(sizes: DataFrame, limit: int, order=("ts", "seq")) -> DataFrame:
    """Prefix admission: a row is let in while the running total stays within ``limit``."""
    whole = row_slices(sizes.withColumn("_all", F.lit(0)), ["_all"], list(order))
    total = running_sum(whole, ["_all"], list(order), "size_bytes", F.col(SLICE), "running_bytes")
    return total.withColumn("admitted", F.col("running_bytes") <= limit).drop("_all", SLICE)


def _admit(limit: int):
    def advance(used, cols):
        out = []
        for size in cols["size_bytes"].tolist() if hasattr(cols["size_bytes"], "tolist") else cols["size_bytes"]:
            ok = size <= 0 or used + size <= limit
            used += size if ok else 0
            out.append(ok)
        return used, [out]

    return advance


def memory_refusal(sizes: DataFrame, limit: int, group=("cache_id",), order=("ts", "seq"), slices=None) -> DataFrame:
    """Ordered admission where a refused row uses up nothing of the limit."""
    result = T.StructType([T.StructField("admitted", T.BooleanType())])
    return ordered_fold(sizes, list(group), list(order), Fold(("size_bytes",), result, lambda: 0, _admit(limit)), slices)


def sliding_ttl_hits(log: DataFrame, ttl_s: int) -> DataFrame:
    """Read-through log with expiry pushed on by every access: hit if the gap is <= ttl."""
    _at_least("ttl_s", ttl_s, 0)
    sliced = row_slices(log, ["cache_id", "key"], ["ts", "seq"])
    linked = previous_in_group(sliced, ["cache_id", "key"], ["ts", "seq"], "ts", F.col(SLICE), "previous_ts").drop(SLICE)
    gap = micros(F.col("ts")) - micros(F.col("previous_ts"))
    return linked.withColumn("hit", F.coalesce(gap <= ttl_s * 1_000_000, F.lit(False)))


def _spaced(gap_us: int, side: str):
    """Greedy choice of rows at least (more than) a gap after the last chosen one."""

    def advance(last, cols):
        t = np.asarray(cols["at_us"], dtype=np.int64)
        chosen = np.zeros(len(t), dtype=bool)
        i = 0
        while True:
            if last is not None:
                i = int(np.searchsorted(t, last + gap_us, side=side))
            if i >= len(t):
                return last, [chosen.tolist()]
            chosen[i] = True
            last = int(t[i])

    return advance


def _spacing(gap_us: int, side: str):
    """What a slice does to the last chosen time: (upto, leaving), and how to apply it.

    From every row the next chosen one is a search away; doubling those steps
    gives the last row chosen when the choice starts there. Starts with the same
    end are one step of the function.
    """

    def transfer(cols):
        t = np.asarray(cols["at_us"], dtype=np.int64)
        step = np.searchsorted(t, t + gap_us, side=side)
        step = np.where(step < len(t), step, np.arange(len(t)))
        while True:
            further = step[step]
            if np.array_equal(further, step):
                break
            step = further
        ends = np.flatnonzero(np.concatenate([step[1:] != step[:-1], [True]])) if len(t) else np.empty(0, np.int64)
        return t[ends], t[step[ends]]

    def apply(last, upto, leaving):
        at = 0 if last is None else int(np.searchsorted(upto, last + gap_us, side=side))
        return int(leaving[at]) if at < len(leaving) else last

    return transfer, apply


def spaced_rows(df: DataFrame, group, order, gap_s: float, name: str, strict: bool, slices=None) -> DataFrame:
    """Marks rows chosen greedily per group: the first, then the next one a gap later.

    ``strict``: later by more than the gap; otherwise by at least the gap.
    """
    _at_least("gap_s", gap_s, 0)
    result = T.StructType([T.StructField(name, T.BooleanType())])
    side = "right" if strict else "left"
    gap_us = int(gap_s * 1_000_000)
    fold = Fold(("at_us",), result, lambda: None, _spaced(gap_us, side), *_spacing(gap_us, side))
    timed = df.withColumn("at_us", micros(F.col(order[0])))
    return ordered_fold(timed, list(group), list(order), fold, slices).drop("at_us")


def fixed_ttl_hits(log: DataFrame, ttl_s: int, slices: int | None = None) -> DataFrame:
    """Read-through log, expiry counted from the last load: hit until strictly past it."""
    loads = spaced_rows(log, ["cache_id", "key"], ["ts", "seq"], ttl_s, "loaded", True, slices)
    return loads.withColumn("hit", ~F.col("loaded")).drop("loaded")


def hit_summary(hits: DataFrame, group=("cache_id",)) -> DataFrame:
    return (
        hits.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("hit")).alias("hits"))
        .withColumn("hit_rate", percent(F.col("hits"), F.col("requests"), 2))
    )


# ------------------------------------------------------------------ replay

REPLAY_RESULT = T.StructType([
    T.StructField("outcome", T.StringType()),
    T.StructField("evicted", T.IntegerType()),
])


def replay_step(capacity: int, sliding: bool = True):
    """State: [[key, expiry_us, ttl_us], ...], least recently used first, < capacity long."""

    def advance(state, cols):
        held = {k: (e, t) for k, e, t in state}
        outcome, evicted = [], []
        for op, key, at, ttl in zip(cols["op"], cols["key"], cols["at_us"], cols["ttl_us"]):
            at, ttl, gone = int(at), int(ttl), 0
            if op == "set":
                held.pop(key, None)
                held[key] = (at + ttl, ttl)
                while len(held) >= capacity:
                    del held[next(iter(held))]
                    gone += 1
                result = "set"
            elif op == "get":
                kept = held.pop(key, None)
                if kept is None or at > kept[0]:
                    result = "miss"
                else:
                    held[key] = (at + kept[1], kept[1]) if sliding else kept
                    result = "hit"
            else:
                result = "deleted" if held.pop(key, None) else "absent"
            outcome.append(result)
            evicted.append(gone)
        return [[k, e, t] for k, (e, t) in held.items()], [outcome, evicted]

    return advance


def cache_replay(ops: DataFrame, capacity: int, sliding: bool = True, slices: int | None = None) -> DataFrame:
    """Any mix of set / get / delete with LRU and expiry, exact, per cache.

    ``ops``: (cache_id, key, ts, seq, op, ttl). The state handed between slices
    holds fewer than ``capacity`` keys.
    """
    _at_least("capacity", capacity, 2)
    timed = ops.withColumns({
        "at_us": micros(F.col("ts")), "ttl_us": F.col("ttl").cast("bigint") * 1_000_000,
    }).na.fill({"ttl_us": 0})
    fold = Fold(("op", "key", "at_us", "ttl_us"), REPLAY_RESULT, list, replay_step(capacity, sliding))
    return ordered_fold(timed, ["cache_id"], ["ts", "seq"], fold, slices).drop("at_us", "ttl_us")
