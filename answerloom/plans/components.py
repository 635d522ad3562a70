"""Connected groups of similar rows, from block-wise spanning edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .search import BLOCK_ROWS, SCORE_CELLS, SLACK, Cells, matrix, side

LAST_LINKS = 500_000
_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels once u[i] and v[i] are joined; a label is the smallest index of its group, and its own label."""
    while True:
        lu, lv = label[u], label[v]
        apart = lu != lv
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        joined = np.unique(np.stack([np.maximum(lu, lv)[apart], np.minimum(lu, lv)[apart]]), axis=1)
        label = label.copy()
        np.minimum.at(label, joined[0], joined[1])
        flat = label[label]
        while not np.array_equal(flat, label):
            label, flat = flat, flat[flat]


def _spanning_edges(left_ids, left, right_ids, right, threshold) -> pa.Table:
    """Edges (smallest id of the block's group, member): fewer than the rows met.

    A group of m alike rows gives m - 1 edges here, not m * m pairs.
    """
    ids, inverse = np.unique(np.concatenate([left_ids, right_ids]), return_inverse=True)
    li, ri = inverse[: len(left_ids)], inverse[len(left_ids):]
    label = np.arange(len(ids))
    step = max(1, SCORE_CELLS // max(1, len(right)))
    for a in range(0, len(left), step):
        scores = left[a:a + step] @ right.T
        rows, cols = np.nonzero(scores >= threshold - SLACK)
        sure = np.round(scores[rows, cols], 6) >= threshold
        rows, cols = rows[sure], cols[sure]
        label = unite(label, li[a:a + step][rows], ri[cols])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table([pa.array(ids[label[moved]]), pa.array(ids[moved])], schema=_EDGE)


def similar_edges(
    vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vec_col: str = "embedding",
    cells: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(src, dst) edges whose connected groups are those of ``cosine >= threshold``.

    Exact copies are linked to their smallest id by an aggregation and scored
    once. Rows within the threshold of a pivot (itself a row) are linked to it
    directly, and pivots near each other are linked up front, so the crowd
    around a pivot is never compared with itself.
    """
    rows = side(vectors, id_col, vec_col, "vec_id")
    rows = rows.filter("vec is not null")
    distinct = stage(rows.groupBy("vec").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vec"), "distinct")
    copies = (
        rows.join(distinct.withColumnRenamed("vec_id", "src"), "vec")
        .select("src", F.col("vec_id").alias("dst")).filter("src <> dst")
    )
    core = math.acos(min(1.0, threshold + SLACK))
    placed = Cells.place(distinct, cells, block_rows, core)
    pivot_sims = np.round(placed.pivots @ placed.pivots.T, 6)
    u, v = np.nonzero(pivot_sims >= threshold)
    joined = unite(np.arange(len(placed.pivots)), u, v)
    ids = placed.pivot_ids
    between = vectors.sparkSession.createDataFrame(
        [(int(ids[joined[i]]), int(ids[i])) for i in range(len(ids)) if joined[i] != i], "src bigint, dst bigint"
    )
    # Pivot ids by cell: at most MAX_CELLS rows.
    names = F.broadcast(vectors.sparkSession.createDataFrame(
        [(2 * i, int(p)) for i, p in enumerate(ids)], "cell int, src bigint"
    ))
    around = placed.members.join(names, "cell").select("src", F.col("vec_id").alias("dst")).filter("src <> dst")

    bound = math.acos(max(-1.0, min(1.0, threshold - SLACK)))
    q = placed.members.select(F.col("vec_id").alias("qid"), "vec", F.lit(bound).alias("bound"), "cell")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _EDGE.empty_table()
        return _spanning_edges(
            left.column("qid").to_numpy(), matrix(left.column("vec")),
            right.column("vec_id").to_numpy(), matrix(right.column("vec")), threshold,
        )

    met = placed.blocks(placed.visits(q, joined=joined), q).applyInArrow(join, "src bigint, dst bigint")
    return met.union(around).union(between).union(copies)


def _finished(edges: DataFrame) -> DataFrame:
    """(id, to) of few edges, in one task: ``to`` is the smallest id of the group."""

    def run(batches):
        read = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if read:
            a, b = (np.concatenate(x) for x in zip(*read))
            ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = unite(np.arange(len(ids)), inverse[:len(a)], inverse[len(a):])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "id bigint, to bigint")


def connected(edges: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(id, group_id) for every id met in ``edges`` (src, dst); group_id is its smallest id.

    Groups are contracted: in a round an id moves to the neighbour with the
    smallest hash, if smaller than its own, and from there one step on; links
    are renamed, equal ones fall together, and those inside one id go. Hashes
    differ by round, so a round shrinks the graph by a constant factor on
    average whatever the order of ids, and all rounds together read a small
    multiple of the links. It always ends: of every link, the end with the
    larger hash moves. Every round is written out; once at most ``last_links``
    links are left, one task joins them.
    """
    links = stage(
        edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while (left := links.count()) > last_links:

        def rank(c: str, seed: int = len(moves)):
            return F.xxhash64(F.lit(seed), c)

        both = links.union(links.select("b", "a"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(rank("b").alias("rank"), "b")).alias("near"))
        to = F.when(F.struct(F.col("near.rank"), F.col("near.b")) < F.struct(rank("id"), F.col("id")), F.col("near.b")).otherwise(F.col("id"))
        step = stage(near.select("id", to.alias("to")), "step")
        onward = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
        move = stage(step.join(onward, "to").select("id", F.col("then").alias("to")), "move")
        moves.append(move)
        first = move.select(F.col("id").alias("a"), F.col("to").alias("_a"))
        second = move.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        renamed = links.join(first, "a").join(second, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        links = stage(renamed.filter("a <> b").distinct(), "links")
    if left:
        last = _finished(links)
        if not moves:
            return last.withColumnRenamed("to", "group_id")
        moves.append(stage(last, "move"))
    if not moves:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("group_id")).limit(0)
    label = moves[-1]
    for move in reversed(moves[:-1]):
        later = label.select(F.col("id").alias("to"), F.col("to").alias("_end"))
        label = stage(move.join(later, "to", "left").select("id", F.coalesce("_end", "to").alias("to")), "labels")
    smallest = stage(label.groupBy("to").agg(F.min("id").alias("group_id")), "groups")
    return label.join(smallest, "to").select("id", "group_id")
