"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. A document becomes the set of its distinct k-word shingles (64-bit hashes).
   Equal sets are one class and go on as one row.
2. A class gets ``trees * depth`` MinHash values. Every tree is one order of
   the classes, sorted by its own ``depth`` values; range partitions cut it, so
   a crowd of alike signatures is spread like anything else. Candidates are
   neighbours in an order, at most ``reach`` rows apart, with a common prefix of
   at least ``min_prefix`` values: in a thin region that is everything with a
   short common prefix, in a crowded one only what shares a long one. So the
   depth adapts to the region.
3. Candidates whose signatures are far from the threshold go. What is left is
   reduced to a spanning forest where it is found, never all pairs of a group.
   Its connected parts hold, with near certainty, every link; they are far
   smaller than the input.
4. Inside a part all links are confirmed on full shingle sets. A part is cut
   into blocks of bounded size, a pair of blocks is a unit of work, and links
   come out as a spanning forest again. Nothing is capped.

Python works on Arrow batches of bounded size; Spark sorts, joins and shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import partitions
from .components import components, unite

TREES, DEPTH = 16, 8
REACH, MIN_PREFIX = 32, 2
SLACK = 0.15  # about four standard deviations of a 128-value estimate at 0.8
BLOCK_SHINGLES = 1 << 17  # shingles of one part in one block; blocks meet in pairs
BROADCAST_MEMBERS = 1_000_000
LAST = (1 << 63) - 1  # stands for a null doc_id
_LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes: k words each, or all words where there are fewer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = _scramble(s * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(s)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20_011).integers(1, 1 << 63, (2, n), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the smallest of each of len(a) random orders."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i:i + 2048, None] * a + b).min(axis=0))
    return (_scramble(low) >> np.uint64(48)).astype(">u2")


def signatures(docs: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig); the last two are null for empty sets."""
    a, b = _factors(trees * depth)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("doc_id"), "text")
    return stage(rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, sig binary"), "forest-signatures")


# Equal 4-bit halves of two bytes, by their XOR.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def forest_links(classes: DataFrame, trees: int, depth: int, reach: int, min_prefix: int, at_least: float) -> DataFrame:
    """(src, dst): spanning links between forest neighbours whose estimate reaches ``at_least``."""
    values = trees * depth
    floor = at_least + (1 - at_least) / 16  # 4-bit halves are equal by chance once in 16

    def plant(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u2").reshape(-1, values)
            low = (sig & 15).astype(np.uint8)
            sketch = (low[:, 0::2] << 4) | low[:, 1::2]
            sketches = pa.array([x.tobytes() for x in sketch])
            for tree in range(trees):
                prefix = np.ascontiguousarray(sig[:, tree * depth:(tree + 1) * depth])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sig), tree, np.int32)), pa.array([x.tobytes() for x in prefix]), batch.column("node"), sketches,
                ], ["tree", "prefix", "node", "sketch"])

    def neighbours(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy()
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u2").reshape(-1, depth)
            node = batch.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, values // 2)
            if kept is not None:
                tree, prefix, node, sketch = (np.concatenate([x, y]) for x, y in zip(kept, (tree, prefix, node, sketch)))
            kept = tuple(x[-reach:] for x in (tree, prefix, node, sketch))
            start = (prefix[1:, :min_prefix] == prefix[:-1, :min_prefix]).all(axis=1) & (tree[1:] == tree[:-1])
            region = np.concatenate([[0], np.cumsum(~start)])
            label = np.arange(len(node))
            i = np.arange(len(node) - 1)
            for apart in range(1, reach + 1):
                i = i[i + apart < len(node)]
                i = i[region[i] == region[i + apart]]  # sorted: who is not together here is not further on
                if not len(i):
                    break
                open_ = i[label[i] != label[i + apart]]
                equal = _EQUAL[sketch[open_] ^ sketch[open_ + apart]].sum(axis=1, dtype=np.int64)
                near = open_[equal >= floor * values]
                if len(near):
                    label = unite(label, near, near + apart)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], schema=_LINK)

    planted = classes.mapInArrow(plant, "tree int, prefix binary, node bigint, sketch binary")
    order = ["tree", "prefix", "node"]
    sown = planted.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    return sown.mapInArrow(neighbours, "src bigint, dst bigint")


def confirm_block(node: np.ndarray, side: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (src, dst) among rows with 100 * intersection >= percent * union.

    ``side`` is 0 or 1: rows of different sides are compared, or, where there is
    one side, all with all. Rows already joined are not compared again.
    """
    n = len(node)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids = np.unique(shingles, return_inverse=True)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    label = np.arange(n)
    both = len(np.unique(side)) > 1
    for p in range(n):
        other = (label != label[p]) & (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        other &= (side != side[p]) if both else (np.arange(n) > p)
        if both and side[p]:
            continue
        q = np.flatnonzero(other)
        if not len(q):
            continue
        own = ids[starts[p]:ends[p]]
        mark[own] = True
        if 4 * sizes[q].sum() > len(ids):
            common = np.add.reduceat(mark[ids], starts, dtype=np.int64)[q]
        else:
            common = np.array([np.count_nonzero(mark[ids[starts[i]:ends[i]]]) for i in q])
        mark[own] = False
        q = q[100 * common >= percent * (sizes[q] + sizes[p] - common)]
        if len(q):
            label = unite(label, np.full(len(q), p), q)
    moved = np.flatnonzero(label != np.arange(n))
    return node[label[moved]], node[moved]


def confirmed_links(docs: DataFrame, parts: DataFrame, k: int, percent: int, block_shingles: int) -> DataFrame:
    """(src, dst) spanning links inside the parts (id, group_id), on full shingle sets."""
    # Written out, so that the join below has plain shuffles on both sides and a hot part can be split.
    sizes = stage(parts.groupBy("group_id").agg(F.sum("n_shingles").alias("_all")), "forest-sizes")
    cut = parts.join(sizes, "group_id").withColumn("_blocks", F.ceil(F.col("_all") / block_shingles).cast("int"))
    cut = stage(cut.withColumn("_block", F.pmod(F.xxhash64("id"), "_blocks").cast("int")).select("id", "group_id", "_blocks", "_block"), "forest-blocks")
    few = cut.count() <= BROADCAST_MEMBERS
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("id"), "text")
    rows = rows.join(F.broadcast(cut) if few else cut, "id")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "group_id", "_blocks", "_block")] + [pa.array(found, pa.binary())],
                ["id", "group_id", "_blocks", "_block", "shingles"])

    full = rows.mapInArrow(sets, "id bigint, group_id bigint, _blocks int, _block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    units = full.withColumn("_other", other).select(
        "group_id", F.least("_block", "_other").alias("a"), F.greatest("_block", "_other").alias("b"),
        (F.col("_block") > F.col("_other")).cast("int").alias("side"), "id", "shingles")
    keys = ["group_id", "a", "b"]
    # The diagonal unit of a row is reached once; a unit of two blocks has both.
    units = units.repartition(*keys).sortWithinPartitions(*keys, "id")

    def confirm(batches):
        waiting, at = [], None

        def work():
            raw = [r["shingles"] for r in waiting]
            src, dst = confirm_block(
                np.array([r["id"] for r in waiting], np.int64), np.array([r["side"] for r in waiting]),
                np.array([len(x) // 8 for x in raw]), np.frombuffer(b"".join(raw), np.uint64), percent)
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], schema=_LINK)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["group_id"], row["a"], row["b"])
                if key != at and waiting:
                    yield work()
                    waiting = []
                at = key
                waiting.append(row)
        if waiting:
            yield work()

    return units.mapInArrow(confirm, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, *, k: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, reach: int = REACH,
    min_prefix: int = MIN_PREFIX, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id linked, over any chain), kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of
    their sets of distinct ``k``-word shingles (lower-cased A-Z, words between
    white space; with fewer words, all of them as one).

    Nulls: null or blank text has an empty set, linked with nothing. Rows with
    the same doc_id are one document; so are those with a null one, which comes
    last. Equal doc_ids with different texts print a row each. A very long text
    is one set of hashes in its task, and a part of many of them is confirmed in
    blocks. Ties don't arise: ids decide. No other column is read. Empty input
    gives no rows.
    """
    signed = signatures(docs, k, trees, depth)
    classes = stage(
        signed.filter("n_shingles > 0").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "forest-classes")
    loose = percent / 100 - SLACK
    parts = components(forest_links(classes, trees, depth, reach, min_prefix, loose))
    sized = parts.join(classes.groupBy(F.col("node").alias("id")).agg(F.max("n_shingles").alias("n_shingles")), "id")
    links = stage(confirmed_links(docs, stage(sized, "forest-parts"), k, percent, block_shingles), "forest-confirmed")
    found = components(links).select(F.col("id").alias("node"), "group_id")
    heads = classes.join(found, "node", "left").select("set_key", F.coalesce("group_id", "node").alias("component_id"))
    heads = stage(heads, "forest-heads")  # plain shuffles on both sides below: a hot set can be split
    own = F.coalesce("component_id", "doc_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(heads, "set_key", "left")

    def back(c):
        return F.when(c != LAST, c)

    return out.select(
        back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(own).alias("component_id"), (own == F.col("doc_id")).alias("kept"))
