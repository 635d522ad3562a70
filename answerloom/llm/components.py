"""Connected groups of ids by contraction: every round merges ids with a neighbour and drops what became one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import stage


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


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, group_id) for every id in ``links`` (src, dst); group_id is the smallest id of the group.

    In a round an id moves to the neighbour with the smallest hash, if smaller
    than its own, and from there one step on; links are renamed and equal ones
    fall together. Hashes differ by round, so a round shrinks the graph by a
    constant factor on average whatever the order of ids, and what all rounds
    read together is a small multiple of the links. Every round is written out.
    """
    edges = stage(links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError("groups did not settle")

        def rank(c: str, seed: int = len(moves)):
            return F.xxhash64(F.lit(seed), c)

        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(rank("b").alias("rank"), "b")).alias("near"))
        to = F.when(F.col("near.rank") < rank("id"), F.col("near.b")).otherwise(F.col("id"))
        step = stage(near.select("id", to.alias("to")), "step")
        onward = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
        move = stage(step.join(onward, "to").select("id", F.col("then").alias("to")), "move")
        moves.append(move)
        left = move.select(F.col("id").alias("a"), F.col("to").alias("_a"))
        right = move.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        renamed = edges.join(left, "a").join(right, "b")
        edges = stage(renamed.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "links")
    if not moves:
        return links.select(F.col("src").alias("id"), F.col("dst").alias("group_id")).limit(0)
    label = moves[-1]
    for move in reversed(moves[:-1]):
        later = label.select(F.col("id").alias("to"), F.col("to").alias("_end"))
        label = stage(move.join(later, "to", "left").select("id", F.coalesce("_end", "to").alias("to")), "labels")
    smallest = stage(label.groupBy("to").agg(F.min("id").alias("group_id")), "groups")
    return label.join(smallest, "to").select("id", "group_id")
