"""Operation logs: projecting, replaying to a state, recovering, retaining."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.entries import expires_at
from ..schemas import LEVELS

STATE = ["key", "level", "value", "created_at", "seq", "expires_at", "ttl_level"]


def project_log(ops: DataFrame) -> DataFrame:
    """Log rows as written: value and ttl only on a set; ``log_date`` to partition by."""
    is_set = F.col("operation") == "set"
    return ops.select(
        "ts", "seq", "operation", "key", "level",
        F.when(is_set, F.col("value")).alias("value"),
        F.when(is_set, F.col("ttl")).alias("ttl"),
        F.to_date("ts").alias("log_date"),
    )


def since(ops: DataFrame, ts) -> DataFrame:
    return ops.filter(F.col("ts") > F.lit(ts))


def _clears(ops: DataFrame) -> DataFrame:
    """Last clear that reaches each level: four rows at most."""
    reached = F.when(F.col("level").isNull(), F.array(*[F.lit(x) for x in LEVELS])).otherwise(F.array("level"))
    return (
        ops.filter("operation = 'clear'")
        .select(F.explode(reached).alias("level"), F.struct("ts", "seq").alias("at"))
        .filter(F.col("level").isin(*LEVELS))
        .groupBy("level").agg(F.max("at").alias("cleared"))
    )


def replay(ops: DataFrame, base: DataFrame | None = None, ttl_anchor=None) -> DataFrame:
    """State (key, level, value, created_at, seq, expires_at, ttl_level) after the log.

    The last write per (key, level) counts unless a later clear reaches it. The
    lifetime of a key is that of its last set in any level; a later delete of
    the key, or clear of that level, drops it. ``base`` is an earlier state
    whose writes all come before ``ops``. Lifetimes run from the event's own
    time, or for all replayed sets from ``ttl_anchor`` (the time of replaying).
    """
    starts = F.col("at.ts") if ttl_anchor is None else F.lit(ttl_anchor)
    at = F.struct("ts", "seq").alias("at")
    writes = ops.filter("operation in ('set', 'delete')").select("key", "level", "operation", "value", "ttl", at)
    ttl_marks = writes.filter("operation = 'delete' or coalesce(ttl, 0) <> 0").select(
        "key", "at",
        F.when(F.col("operation") == "set", expires_at(starts, F.col("ttl"))).alias("expires_at"),
        F.col("level").alias("ttl_level"),
    )
    stored = writes.select("key", "level", "operation", "value", "at")
    if base is not None:
        held = F.struct(F.col("created_at").alias("ts"), "seq").alias("at")
        stored = stored.unionByName(base.select("key", "level", F.lit("set").alias("operation"), "value", held))
        ttl_marks = ttl_marks.unionByName(
            base.filter("expires_at is not null").select("key", held, "expires_at", "ttl_level")
        )
    clears = F.broadcast(_clears(ops))
    last = stored.groupBy("key", "level").agg(
        F.max_by(F.struct("operation", "value"), "at").alias("w"), F.max("at").alias("at")
    )
    kept = (
        last.join(clears, "level", "left")
        .filter("w.operation = 'set' and (cleared is null or at > cleared)")
        .select("key", "level", "w.value", F.col("at.ts").alias("created_at"), "at.seq")
    )
    marks = ttl_marks.groupBy("key").agg(
        F.max_by(F.struct("expires_at", "ttl_level"), "at").alias("m"), F.max("at").alias("at")
    )
    lifetimes = (
        marks.select("key", "at", "m.*").filter("expires_at is not null")
        .join(clears.withColumnRenamed("level", "ttl_level"), "ttl_level", "left")
        .filter("cleared is null or at > cleared")
        .select("key", "expires_at", "ttl_level")
    )
    return kept.join(lifetimes, "key", "left").select(*STATE)


def recover(snapshot: DataFrame, ops: DataFrame, snapshot_ts) -> DataFrame:
    """Snapshot plus the log after it."""
    return replay(since(ops, snapshot_ts), snapshot)


def keep_newest(snapshots: DataFrame, n: int = 5, by: str = "snapshot_ts") -> DataFrame:
    """Rows to drop: all but the ``n`` newest. ``n`` rows are broadcast."""
    newest = snapshots.select(by).distinct().orderBy(F.col(by).desc()).limit(n)
    return snapshots.join(F.broadcast(newest), by, "left_anti")


def older_than(files: DataFrame, now, max_age_s: int = 86_400, by: str = "ts") -> DataFrame:
    cutoff = F.lit(now) - F.make_dt_interval(secs=F.lit(max_age_s))
    return files.filter(F.col(by) < cutoff)


def log_stats(ops: DataFrame) -> DataFrame:
    op = F.col("operation")
    return ops.agg(
        F.count(F.lit(1)).alias("operations_logged"),
        F.count_if(op == "set").alias("sets"), F.count_if(op == "get").alias("gets"),
        F.count_if(op == "delete").alias("deletes"), F.count_if(op == "clear").alias("clears"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
