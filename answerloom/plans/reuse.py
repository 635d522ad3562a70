"""Reuse distance: distinct keys touched since a key was last touched.

Positions 1..n number the accesses of a cache; ``prev`` is the position of the
same key's last access (0 if none). The distinct keys between are

    #{ j < i : prev(j) <= prev(i) } - prev(i)

so each access needs a count over two dimensions. A cache of any length is cut
into chunks of positions and the count is put together from three parts:

* same chunk as i: counted inside the chunk;
* earlier chunks, prev in the same chunk as prev(i): positions are the prev of
  at most one access, so these groups are bounded too;
* earlier chunks, prev in an earlier chunk: counts per (chunk, prev chunk) are
  merged by levels, each block of 2**l chunks asking the one to its left.

No task holds more than one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .ordering import SLICE, previous_in_group, rank_in_group, row_slices, running_sum

CHUNK_ROWS = 1_000_000


def count_before(order_key: np.ndarray, value: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """For each i: how many j with order_key(j) < order_key(i) have value(j) <= probe(i).

    Keys differ. Halves of ever larger blocks: rows of the right half are
    counted against the sorted left half.
    """
    n = len(order_key)
    by_key = np.argsort(order_key)
    known = np.unique(value)
    stored = np.searchsorted(known, value)[by_key] + 1
    asked = np.searchsorted(known, probe, side="right")[by_key]
    width = len(known) + 1
    place = np.arange(n)
    total = np.zeros(n, dtype=np.int64)
    size = 1
    while size < n:
        base = place // (2 * size) * width
        right = (place // size) % 2 == 1
        lefts = np.sort((base + stored)[~right])
        total[right] += np.searchsorted(lefts, (base + asked)[right], side="right")
        total[right] -= np.searchsorted(lefts, base[right], side="right")
        size *= 2
    counts = np.empty(n, dtype=np.int64)
    counts[by_key] = total
    return counts


def positions(log: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``prev`` (0 = first access) per cache, in (ts, seq) order."""
    sliced = row_slices(log, ["cache_id"], ["ts", "seq"])
    numbered = stage(rank_in_group(sliced, ["cache_id"], [F.col("ts"), F.col("seq")], [F.col(SLICE)], name="pos"), "numbered")
    # A slice of the cache bounds what any key of it has there.
    linked = previous_in_group(numbered, ["cache_id", "key"], ["pos"], "pos", F.col(SLICE), name="prev").drop(SLICE)
    return linked.withColumn("prev", F.coalesce("prev", F.lit(0)).cast("bigint"))


def _grouped(group: np.ndarray, order_key: np.ndarray, value: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """:func:`count_before` inside each group, for many groups in one go.

    Later groups get larger keys and values, so all rows of the groups before
    count, and their number is taken off again.
    """
    low = min(value.min(), probe.min())
    width = max(value.max(), probe.max()) - low + 1
    shift = group * width
    span = order_key.max() - order_key.min() + 1
    counts = count_before(group * span + order_key - order_key.min(), shift + value - low, shift + probe - low)
    sizes = np.bincount(group)
    before = np.cumsum(sizes) - sizes
    return counts - before[group]


def _ids(table: pa.Table, chunk: str) -> np.ndarray:
    """Dense numbers of the (cache_id, chunk) pairs."""
    cache = np.unique(table.column("cache_id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    part = table.column(chunk).to_numpy()
    part = part - part.min()
    return np.unique(cache.astype(np.int64) * (part.max() + 1) + part, return_inverse=True)[1]


def _counted(table: pa.Table, counts: np.ndarray, repeated: np.ndarray) -> pa.Table:
    kept = table.select(["cache_id", "pos"]).filter(pa.array(repeated))
    return kept.append_column("n", pa.array(counts[repeated], pa.int64()))


def _within_chunk(table: pa.Table) -> pa.Table:
    pos, prev = table.column("pos").to_numpy(), table.column("prev").to_numpy()
    return _counted(table, _grouped(_ids(table, "chunk"), pos, prev, prev), prev > 0)


def _within_prev_chunk(table: pa.Table) -> pa.Table:
    chunk, prev = table.column("chunk").to_numpy(), table.column("prev").to_numpy()
    return _counted(table, _grouped(_ids(table, "prev_chunk"), prev, chunk, chunk - 1), prev > 0)


def _long_caches(slim: DataFrame) -> DataFrame:
    return slim.groupBy("cache_id").agg(F.max("chunk").alias("last")).filter("last > 0")


def _corner_counts(slim: DataFrame) -> DataFrame:
    """(cache_id, chunk, prev_chunk, far): accesses of earlier chunks whose prev lies in a chunk before prev_chunk.

    Accesses are counted per (chunk, prev_chunk) first. The chunks before one
    are the left halves of the power-of-two blocks in whose right half it lies.
    So at each level a count is either stored by its block, or asks for what is
    stored there with a smaller prev_chunk: a running sum along prev_chunk.
    Counts times levels rows in all, ordered over as many tasks as there are
    partitions; there is no table of all pairs of chunks, and none of this for
    a cache of one chunk.
    """
    long = _long_caches(slim)
    cells = stage(
        slim.join(long.select("cache_id"), "cache_id", "left_semi")
        .groupBy("cache_id", "chunk", "prev_chunk").agg(F.count(F.lit(1)).alias("c")), "chunk-counts")
    last = cells.agg(F.max("chunk")).first()[0]
    if not last:
        return cells.select("cache_id", "chunk", "prev_chunk", F.lit(0).cast("bigint").alias("far"))
    level = F.explode(F.sequence(F.lit(0), F.lit(int(last).bit_length() - 1))).alias("level")
    each = cells.select("*", level)
    asks = F.expr("shiftright(chunk, level) & 1") == 1
    met = each.select(
        "cache_id", "level", F.expr("shiftright(chunk, level + 1)").alias("block"), "prev_chunk",
        # Equal prev_chunks don't count, so who asks comes before what is stored.
        (~asks).cast("int").alias("stored"), "chunk", F.when(asks, 0).otherwise(F.col("c")).alias("c"))
    group, order = ["cache_id", "level", "block"], ["prev_chunk", "stored"]
    summed = running_sum(row_slices(met, group, order), group, [*order, "chunk"], "c", F.col(SLICE))
    return summed.filter("stored = 0").groupBy("cache_id", "chunk", "prev_chunk").agg(F.sum("running").alias("far"))


def reuse_distance(log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Log rows plus ``pos``, ``prev`` and ``distance`` (null on a key's first access)."""

    def chunk_of(c):
        return F.floor((F.col(c) - 1) / chunk_rows)

    placed = stage(
        positions(log).withColumns({
            "chunk": chunk_of("pos"),
            "prev_chunk": F.when(F.col("prev") > 0, chunk_of("prev")).otherwise(F.lit(-1)),
        }),
        "positions",
    )
    slim = placed.select("cache_id", "pos", "prev", "chunk", "prev_chunk")
    schema = f"cache_id {log.schema['cache_id'].dataType.simpleString()}, pos bigint, n bigint"
    # Many small caches share a call: chunks are dealt out to buckets of about
    # one chunk's rows, never fewer buckets than shuffle partitions.
    rows = slim.count()
    buckets = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // chunk_rows))

    def bucket(chunk):
        return F.pmod(F.xxhash64("cache_id", chunk), F.lit(buckets)).alias("bucket")

    inside = slim.groupBy(bucket("chunk")).applyInArrow(_within_chunk, schema)
    # With a single chunk per cache there is no earlier chunk to look at.
    crossing = slim.filter("prev_chunk >= 0").join(_long_caches(slim), "cache_id", "left_semi")
    beside = crossing.groupBy(bucket("prev_chunk")).applyInArrow(_within_prev_chunk, schema)
    near = inside.unionByName(beside).groupBy("cache_id", "pos").agg(F.sum("n").alias("near"))
    return (
        placed.join(_corner_counts(slim), ["cache_id", "chunk", "prev_chunk"], "left")
        .join(near, ["cache_id", "pos"], "left")
        .withColumn("distance", F.col("near") + F.coalesce("far", F.lit(0)) - F.col("prev"))
        .drop("near", "far", "chunk", "prev_chunk")
    )
