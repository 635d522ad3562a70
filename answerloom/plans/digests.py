"""Which documents changed between two tables, from trees of digests.

Documents are dealt by the hash of their id to the leaves of a tree with
``FAN`` children a node. A leaf's digest is a sum over its documents, so it
depends on neither order nor partitions; a node's is a sum over its children.
Two trees are compared from the root down, and only below nodes that differ;
at the bottom, only documents of leaves that differ are compared one by one.

A tree is one small row per node and can be kept: then the tables themselves
are read for the leaves that differ, and trees are compared without either.
Leaves number documents / LEAF_ROWS, so both the tree and a leaf stay small
however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, stage

FAN_BITS = 4
LEAF_ROWS = 1_000
MAX_LEVELS = 10
SPAN = (1 << 61) - 1  # sums are kept below it


def levels_for(documents: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root at which a leaf has about ``leaf_rows`` documents."""
    return min(MAX_LEVELS, max(0, math.ceil(math.log2(max(1, documents / leaf_rows)) / FAN_BITS)))


def _number(c: Column) -> Column:
    """60 bits of a digest as a number that can be summed."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(38,0)")


def _summed(c: Column) -> Column:
    return (F.coalesce(F.sum(c), F.lit(0)) % SPAN).cast("bigint")


def _leaf(id_col: str, levels: int) -> Column:
    return F.xxhash64(F.col(id_col).cast("string")).bitwiseAND((1 << (FAN_BITS * levels)) - 1)


def _told(id_col: str, text: str) -> Column:
    """An id and a text, so that neither a null nor where one ends is in doubt."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    known = F.concat(F.col(id_col).isNull().cast("string"), F.lit("/"), F.length(own).cast("string"), F.lit("/")).cast("binary")
    said = F.coalesce(F.concat(F.lit("+").cast("binary"), F.col(text).cast("binary")), F.lit("-").cast("binary"))
    return F.concat(known, own, said)


def digest_tree(documents: DataFrame, levels: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(level, node, digest, n): level 0 is the root; a node's children are node * 16 to node * 16 + 15."""
    row = stage(
        documents.groupBy(_leaf(id_col, levels).alias("node")).agg(_summed(_number(_told(id_col, text))).alias("digest"), F.count(F.lit(1)).alias("n"))
        .select(F.lit(levels).alias("level"), "node", "digest", "n"), "digests")
    tree = row
    for level in range(levels - 1, -1, -1):
        said = F.concat_ws("/", F.col("node").cast("string"), F.col("digest").cast("string"), F.col("n").cast("string")).cast("binary")
        row = row.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(_summed(_number(said)).alias("digest"), F.sum("n").alias("n"))
        row = stage(row.select(F.lit(level).alias("level"), "node", "digest", "n"), "digests")
        tree = tree.unionByName(row)
    return tree


def unequal_leaves(before: DataFrame, after: DataFrame, levels: int) -> DataFrame:
    """(node) of the leaves in which two trees of ``levels`` levels differ; equal branches are not gone into."""
    open_ = None
    for level in range(levels + 1):
        a, b = (
            t.filter(F.col("level") == level).select("node", F.struct("digest", "n").alias(name))
            for t, name in ((before, "_a"), (after, "_b")))
        if open_ is not None:
            parents = broadcast_if_small(open_.withColumnRenamed("node", "_parent"))
            a, b = (t.join(parents, F.shiftright("node", FAN_BITS) == F.col("_parent"), "left_semi") for t in (a, b))
        open_ = stage(a.join(b, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node"), "unequal")
        if open_.isEmpty():
            break
    return open_


def changed_documents(
    before: DataFrame, after: DataFrame, id_col: str = "doc_id", text: str = "text", levels: int | None = None,
    trees: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(id, change): added, removed or changed between two tables.

    ``trees``: kept digest trees of both, of ``levels`` levels. Rows that share
    an id are one document, changed if any of them is; null ids are one too.
    """
    if trees is None:
        levels = levels_for(before.count()) if levels is None else levels
        trees = tuple(digest_tree(t, levels, id_col, text) for t in (before, after))
    elif levels is None:
        raise ValueError("say how many levels the trees have")
    leaves = broadcast_if_small(unequal_leaves(*trees, levels))

    def told(table: DataFrame, name: str) -> DataFrame:
        near = table.select(F.col(id_col).alias("_id"), _number(_told(id_col, text)).alias("_d"), _leaf(id_col, levels).alias("node"))
        return near.join(leaves, "node", "left_semi").groupBy("_id").agg(F.struct(_summed(F.col("_d")).alias("d"), F.count(F.lit(1)).alias("n")).alias(name))

    a, b = told(before, "_a"), told(after, "_b").withColumnRenamed("_id", "_other")
    met = a.join(b, F.col("_id").eqNullSafe(F.col("_other")), "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return met.select(F.when(F.col("_a").isNull(), F.col("_other")).otherwise(F.col("_id")).alias(id_col), change.alias("change"))
