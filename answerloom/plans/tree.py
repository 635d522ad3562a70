"""A vector index of cells in levels: built, saved, added to, removed from, searched.

**Levels.** All rows start under one root. A node with more than ``cell_rows``
rows gets at most ``BRANCH`` pivots drawn from them, its rows go to the nearest
one, and so on until cells are small enough. The number of pivots grows with
the index, and no cell grows with it; only a crowd of equal vectors, or one
that ``MAX_LEVELS`` levels have not parted, stays together and is cut by hash
where it is scored. A root with few rows is the only cell. Every node keeps the largest angle between its pivot and
anything below it.

**Routing.** A query goes down from the root and into a child only if the
triangle inequality on angles lets something there reach the query's bound. A
tree of at most ``SMALL_TREE_BYTES`` (its size is counted) is sent to the tasks
and gone through in one pass; a larger one is met level by level, in blocks of
bounded rows, and never leaves the executors.

**Scoring.** Cells that lie near each other make a bundle of about
``block_rows`` rows, or more of a large search (:meth:`Tree.wide`). A query travels once to a bundle it visits, with a mask of
the cells it wants there, and is scored on those only.

**Saved index.** ``path/v<k>`` holds one build: ``nodes``, ``members`` and
``radii``, each in folders by batch number ``seq``, beside ``removed`` and
``batches``. :meth:`Tree.append` routes new rows to their cells and adds their
members and the radii they need; :meth:`Tree.remove` and :meth:`Tree.clear` add
tombstones, which hold for rows of earlier batches only, so that a vector can
come back. A batch counts once its row in ``batches`` is written, and one that
failed is overwritten by the next, so readers see whole batches. Radii only
grow and counts only bound, so searches stay exact. :meth:`Tree.compacted`
builds the next version from what is alive once changes are a quarter of it.
One writer at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import broadcast_if_small, stage
from .search import (
    BLOCK_ROWS, FOUND, FOUND_DDL, SCORE_CELLS, SLACK, Best, angles, found_table, keep_best, matrix, meeting, valid,
)

BRANCH = 64
CELL_ROWS = 4_096
MAX_LEVELS = 9  # node numbers have six bits a level
SMALL_TREE_BYTES = 64 << 20
MERGE_SHARE = 0.25
BUNDLE_CELLS = 62  # cells of a bundle are bits of a bigint
FEW_CELLS = 100_000
ROUTED = 4_096  # queries that go down a tree at a time
VISITS_HELD = 500_000  # visits of theirs
WIDE = 4  # so many times ``block_rows`` a block may have a side, in BLOCK_BYTES,
BLOCK_BYTES = 16 << 20
BLOCKS_A_CORE = 12  # if this many blocks a core are left
TINY = 1e-6  # radius of a node that pivots cannot part
ZERO, ROOT = 0, 1
NODES = "node bigint, parent bigint, vec array<double>, leaf boolean"
RADII = "node bigint, radius double, n bigint"
MEMBERS = "vec_id bigint, vec array<float>, node bigint"
BATCHES = "seq bigint, kind string, rows bigint"
_KIDS = "array<struct<node: bigint, vec: array<double>, radius: double, leaf: boolean>>"


class _Kids:
    """The children of one node, as arrays."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["node"])
        self.node = np.array([r["node"] for r in rows], dtype=np.int64)
        pivots = np.array([r["vec"] for r in rows], dtype=np.float64)
        self.pivots = pivots / np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))
        self.radius = np.array([r["radius"] if r["radius"] is not None else math.pi for r in rows])
        self.leaf = np.array([bool(r["leaf"]) for r in rows])


def _pieces(batch, width: int):
    step = max(1, SCORE_CELLS // max(1, width))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _kids_of(nodes: DataFrame) -> DataFrame:
    """(parent, kids): at most BRANCH entries a row."""
    kid = F.struct("node", "vec", "radius", "leaf")
    return nodes.filter("parent is not null").groupBy("parent").agg(F.collect_list(kid).cast(_KIDS).alias("kids"))


def _small(kids: DataFrame, most_bytes: int, at_most: int | None = None) -> dict[int, _Kids] | None:
    """The children of all nodes if they are few enough to send out, else None; ``at_most`` bytes are known to do."""
    size = at_most
    if size is None or size > most_bytes:
        size = kids.agg(F.sum(F.size("kids") * (8 * F.size(F.col("kids")[0]["vec"]) + 32))).first()[0] or 0
    if size > most_bytes:
        return None
    return {r["parent"]: _Kids([k.asDict() for k in r["kids"]]) for r in kids.collect()}


def _at_nodes(rows: DataFrame, kids: DataFrame, sent: dict | None, work: Callable, ddl: str, id_col: str) -> DataFrame:
    """``work(kids, rows of one node)`` for the rows of every node that has children.

    ``rows`` has ``node``. Where the children are not ``sent`` out, rows and
    children meet in blocks of at most BLOCK_ROWS rows of a node.
    """
    if sent is not None:
        shared = rows.sparkSession.sparkContext.broadcast(sent)

        def run(batches):
            for batch in batches:
                node = batch.column("node").to_numpy()
                for n in np.unique(node).tolist():
                    if n in shared.value:
                        for piece in _pieces(batch.filter(pa.array(node == n)), len(shared.value[n].node)):
                            yield from work(shared.value[n], piece)

        return rows.mapInArrow(run, ddl)
    parts = stage(rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_parts")), "tree-crowds")
    left = rows.join(parts, "node").withColumn("_part", F.expr(f"pmod(xxhash64({id_col}), _parts)").cast("int"))
    right = kids.withColumnRenamed("parent", "node").join(parts, "node").withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)")))
    right = right.select(F.col("node").alias("node"), F.col("_part").alias("_part"), "kids")

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        done = []
        if one.num_rows and other.num_rows:
            own = _Kids(other.column("kids")[0].as_py())
            for batch in one.combine_chunks().to_batches():
                for piece in _pieces(batch, len(own.node)):
                    done += work(own, piece)
        return pa.Table.from_batches(done) if done else _empty(ddl)

    return left.groupBy("node", "_part").cogroup(right.groupBy("node", "_part")).applyInArrow(meet, ddl)


def _empty(ddl: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")]).empty_table()


def _assign(kids: _Kids, batch: pa.RecordBatch):
    """Rows under the nearest child, with the angle to its pivot."""
    angle = angles(matrix(batch.column("vec")), kids.pivots)
    near = angle.argmin(axis=1)
    yield pa.RecordBatch.from_arrays(
        [batch.column("vec_id"), batch.column("vec"), pa.array(kids.node[near]), pa.array(angle[np.arange(len(near)), near]), pa.array(kids.leaf[near])],
        names=["vec_id", "vec", "node", "away", "leaf"])


_ASSIGNED = "vec_id bigint, vec array<float>, node bigint, away double, leaf boolean"


def _descend(nearest_only: bool):
    """Queries to the children that can hold something within their bound."""

    def work(kids: _Kids, batch: pa.RecordBatch):
        m = matrix(batch.column("vec"))
        angle = angles(m, kids.pivots)
        if nearest_only:
            rows, cols = np.arange(len(m)), angle.argmin(axis=1)
        else:
            bound = batch.column("bound").to_numpy()
            zero = ~m.any(axis=1)
            rows, cols = np.nonzero((angle - kids.radius[None, :] <= bound[:, None] + SLACK) | zero[:, None])
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("qid").take(at), batch.column("vec").take(at), batch.column("bound").take(at), pa.array(kids.node[cols]), pa.array(kids.leaf[cols])],
            names=["qid", "vec", "bound", "node", "leaf"])

    return work


def _ways_down(kids: dict[int, _Kids], m: np.ndarray, bound: np.ndarray, nearest_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the rows of ``m``, branch by branch, so that one branch's rows are held besides what is returned."""
    ends: list[tuple] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    zero = ~m.any(axis=1)
    open_ = [(ROOT, np.arange(len(m)))]
    while open_:
        node, rows = open_.pop()
        if node not in kids:
            continue
        own = kids[node]
        angle = angles(m[rows], own.pivots)
        if nearest_only:
            can = np.zeros(angle.shape, dtype=bool)
            can[np.arange(len(rows)), angle.argmin(axis=1)] = True
        else:
            can = (angle - own.radius[None, :] <= bound[rows, None] + SLACK) | zero[rows, None]
        for j, n in enumerate(own.node.tolist()):
            on = rows[can[:, j]]
            if not len(on):
                continue
            if own.leaf[j]:
                ends.append((on, np.full(len(on), n)))
            else:
                open_.append((n, on))
    rows, to = (np.concatenate(x) for x in zip(*ends))
    return rows, to


def _bit():
    return F.expr("shiftleft(1L, bit)")


_VISITS = "qid bigint, bundle bigint, mask bigint"
_VISITING = "qid bigint, vec array<float>, bound double, node bigint, leaf boolean"


class Tree:
    """Index vectors in cells of bounded size (see the module)."""

    def __init__(
        self, nodes: DataFrame, radii: DataFrame, members: DataFrame, block_rows: int = BLOCK_ROWS,
        most_bytes: int = SMALL_TREE_BYTES, path: str | None = None, single: bool = False,
    ):
        """``nodes``: the tree; ``radii``: one or more rows a node, the largest counts; ``members``: live rows by leaf.

        ``single``: the root is known to be the only cell.
        """
        self.spark = members.sparkSession
        self.nodes, self.radii, self.members = nodes, radii, members
        self.block_rows, self.most_bytes, self.path = block_rows, most_bytes, path
        covering = radii.groupBy("node").agg(F.max("radius").alias("radius"))
        # A node nothing was ever placed under has no radius and is no child.
        self.kids = _kids_of(nodes.join(covering, "node"))
        self.sent = {} if single else _small(self.kids, most_bytes)
        if self.sent is None:
            self.kids = stage(self.kids, "tree-kids")
        self.sizes = stage(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
        loose = self.sizes.select("node", "n", F.col("node").isin(ZERO, ROOT).alias("loose")).groupBy("loose").agg(F.sort_array(
            F.collect_set(F.when(F.col("loose"), F.col("node")))).alias("nodes"), F.sum("n").alias("n")).collect()
        self.empty = not loose
        self.rows = sum(r["n"] for r in loose)
        # Zero vectors, and rows of a tree without cells, lie under no pivot.
        self.loose = [n for r in loose for n in r["nodes"]]
        self.rootless = self.kids.isEmpty() if self.sent is None else not self.sent
        self._packed: dict[int, tuple[DataFrame, list | None]] = {}

    def wide(self, asked: int) -> int:
        """Rows a side of the blocks of ``asked`` queries.

        Each side travels once for every block of the other, so what is moved
        falls with the size of blocks: they have up to WIDE times ``block_rows``
        where all cores still have blocks enough.
        """
        side = math.sqrt(asked * self.rows / (BLOCKS_A_CORE * self.spark.sparkContext.defaultParallelism))
        if side <= self.block_rows:
            return self.block_rows
        width = self.members.select(F.size("vec").alias("width")).first()["width"]
        return int(max(self.block_rows, min(side, WIDE * self.block_rows, BLOCK_BYTES // (4 * max(1, width)))))

    def bundles(self, side: int | None = None) -> tuple[DataFrame, list | None]:
        """(node, bundle, bit, parts) of every cell, and the same as a list of rows where cells are few.

        Cells are packed, up to about ``side`` (or ``block_rows``) rows, in the
        order of their way down from the root: all of them where they are few,
        else those of each parent.
        """
        side = side or self.block_rows
        if side not in self._packed:
            few = self.sizes.limit(FEW_CELLS + 1).count() <= FEW_CELLS
            # Six bits a level: shifted to the same depth, nodes stand in the order of their branches.
            level = F.floor((F.log2(F.greatest("node", F.lit(1))) + 1e-6) / 6)
            cells = self.sizes.withColumn("_way", F.expr("node").cast("bigint") * F.pow(F.lit(64.0), F.lit(MAX_LEVELS) - level)) \
                .withColumn("_in", F.lit(0).cast("bigint") if few else F.shiftright("node", 6))
            w = Window.partitionBy("_in").orderBy("_way", "node")
            cells = cells.withColumns({
                "_rows": F.floor((F.sum("n").over(w) - F.col("n")) / side),
                "_cells": F.floor((F.row_number().over(w) - 1) / BUNDLE_CELLS)})
            mine = Window.partitionBy("_in", "_rows", "_cells")
            cells = stage(cells.select(
                "node", F.min("node").over(mine).alias("bundle"),
                (F.row_number().over(mine.orderBy("_way", "node")) - 1).cast("int").alias("bit"),
                F.ceil(F.sum("n").over(mine) / side).cast("int").alias("parts")), "tree-bundles")
            self._packed[side] = cells, cells.collect() if few else None
        return self._packed[side]

    # ------------------------------------------------------------ building

    @classmethod
    def _grow(cls, rows: DataFrame, cell_rows: int, branch: int, most_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
        """(nodes, radii, members, whether the root is the only cell) of ``rows`` (vec_id, vec), which are read once per level."""
        spark = rows.sparkSession
        zero = ~F.exists("vec", lambda x: x != 0)
        placed = rows.withColumn("node", F.when(zero, ZERO).otherwise(ROOT).cast("bigint"))
        facts = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).collect()
        count, width = {r["node"]: r["n"] for r in facts}, max([r["width"] for r in facts], default=0)
        top = [(ROOT, None, None, False)] + ([(ZERO, None, None, True)] if ZERO in count else [])
        nodes = spark.createDataFrame(top, NODES)
        radii = spark.createDataFrame([(n, math.pi, count[n]) for n in count], RADII)
        n = count.get(ROOT, 0)
        if n <= cell_rows:
            return nodes, radii, placed.select("vec_id", "vec", "node"), True
        members = placed.filter(F.col("node") == ZERO).select("vec_id", "vec", "node")
        open_, open_nodes = placed.filter(F.col("node") == ROOT).select("vec_id", "vec", "node"), 1
        crowd = spark.createDataFrame([(ROOT, n)], "node bigint, n bigint")
        for level in range(MAX_LEVELS):
            if not open_nodes:
                break
            few = F.broadcast if open_nodes * branch <= 100_000 else (lambda df: df)
            # Enough children to make cells half full.
            wanted = F.least(F.lit(branch), F.greatest(F.ceil(F.col("n") * 2 / cell_rows), F.lit(2)))
            order = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(level), "vec_id"), "vec_id")
            drawn = open_.select("vec_id", "node").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= branch)
            drawn = drawn.join(few(crowd), "node").filter(F.col("r") <= wanted).select("vec_id", "node", "r")
            # At most ``branch`` rows a node; the vectors come along by id.
            child = (F.col("node") * BRANCH + F.col("r") - 1).alias("node")
            pivots = stage(
                open_.join(few(drawn), ["vec_id", "node"])
                .select(child, F.col("node").alias("parent"), F.col("vec").cast("array<double>").alias("vec")).dropDuplicates(["node"]), "tree-pivots")
            kids = _kids_of(pivots.withColumns({"radius": F.lit(None).cast("double"), "leaf": F.lit(False)}))
            sent = _small(kids, most_bytes, open_nodes * branch * (8 * width + 32))
            moved = stage(_at_nodes(open_, kids, sent, _assign, _ASSIGNED, "vec_id"), "tree-level")
            stats = moved.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
            leaf = (F.col("n") <= cell_rows) | (F.col("radius") <= TINY) | F.lit(level == MAX_LEVELS - 1)
            known = stage(pivots.join(stats, "node").withColumn("leaf", leaf), "tree-nodes")
            nodes = nodes.unionByName(known.select("node", "parent", "vec", "leaf"))
            radii = radii.unionByName(known.select("node", "radius", "n"))
            moved = moved.select("vec_id", "vec", "node")
            crowd = known.filter("not leaf").select("node", "n")
            open_nodes = crowd.count()
            if not open_nodes:
                members = members.unionByName(moved)
                break
            still = broadcast_if_small(crowd.select("node"))
            members = members.unionByName(moved.join(still, "node", "left_anti").select("vec_id", "vec", "node"))
            open_ = stage(moved.join(still, "node", "left_semi").select("vec_id", "vec", "node"), "tree-open")
        return nodes, radii, members, False

    @classmethod
    def build(
        cls, index: DataFrame, path: str | None = None, cell_rows: int = CELL_ROWS, branch: int = BRANCH,
        block_rows: int = BLOCK_ROWS, most_bytes: int = SMALL_TREE_BYTES, staged: bool = False,
    ) -> Tree:
        """From (vec_id, vec) rows; null vectors are left out. ``path`` keeps the index for later. ``staged``: the rows are written out already."""
        if not 2 <= branch <= BRANCH:
            raise ValueError(f"branch must lie between 2 and {BRANCH}")
        rows = index.select("vec_id", "vec")
        rows = (rows if staged else stage(rows, "tree-rows")).filter("vec is not null")
        nodes, radii, members, single = cls._grow(rows, cell_rows, branch, most_bytes)
        if path is None:
            return cls(nodes, radii, members, block_rows, most_bytes, single=single)
        return cls._write(index.sparkSession, path, 1, nodes, radii, members, block_rows, most_bytes)

    # --------------------------------------------------------------- saved

    @classmethod
    def _write(cls, spark, path, version, nodes, radii, members, block_rows, most_bytes) -> Tree:
        home = f"{path}/v{version}"
        nodes.write.mode("overwrite").parquet(f"{home}/nodes")
        radii.write.mode("overwrite").parquet(f"{home}/radii/seq=0")
        # Rows of a cell lie together, so that a filter on cells skips row groups.
        members.hint("rebalance", "node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{home}/members/seq=0")
        rows = spark.read.schema(MEMBERS).parquet(f"{home}/members/seq=0").count()
        spark.createDataFrame([(0, "build", rows)], BATCHES).write.mode("overwrite").parquet(f"{home}/batches/seq=0")
        # Readers take the latest version named here, and it is named last.
        spark.createDataFrame([(version,)], "version bigint").write.mode("append").parquet(f"{path}/versions")
        return cls.read(spark, path, block_rows, most_bytes)

    @staticmethod
    def _home(spark: SparkSession, path: str) -> tuple[str, int]:
        version = spark.read.schema("version bigint").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
        return f"{path}/v{version}", version

    @classmethod
    def read(cls, spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS, most_bytes: int = SMALL_TREE_BYTES) -> Tree:
        home, _ = cls._home(spark, path)
        # One row a batch, and compaction bounds their number.
        batches = spark.read.schema(BATCHES).parquet(f"{home}/batches/*").collect()
        rows = [b["seq"] for b in batches if b["kind"] in ("build", "append")]
        gone = [b["seq"] for b in batches if b["kind"] == "remove"]
        cleared = max([b["seq"] for b in batches if b["kind"] == "clear"], default=-1)

        def batch(kind: str, seqs: list[int], ddl: str) -> DataFrame:
            frames = [spark.read.schema(ddl).parquet(f"{home}/{kind}/seq={s}").withColumn("seq", F.lit(s).cast("bigint")) for s in sorted(seqs)]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            return out

        held = [s for s in rows if s > cleared]
        members = batch("members", held, MEMBERS) if held else spark.createDataFrame([], MEMBERS + ", seq bigint")
        if gone:
            dead = batch("removed", gone, "vec_id bigint").groupBy("vec_id").agg(F.max("seq").alias("_dead"))
            members = members.join(broadcast_if_small(dead), "vec_id", "left").filter("_dead is null or seq > _dead")
        return cls(
            spark.read.schema(NODES).parquet(f"{home}/nodes"), batch("radii", rows, RADII).drop("seq"),
            members.select("vec_id", "vec", "node"), block_rows, most_bytes, path)

    def _next(self) -> tuple[str, int]:
        if self.path is None:
            raise ValueError("only a saved index can be changed")
        home, _ = self._home(self.spark, self.path)
        last = self.spark.read.schema(BATCHES).parquet(f"{home}/batches/*").agg(F.max("seq")).first()[0]
        return home, last + 1

    def _close(self, home: str, seq: int, kind: str, rows: int) -> Tree:
        self.spark.createDataFrame([(seq, kind, rows)], BATCHES).write.mode("overwrite").parquet(f"{home}/batches/seq={seq}")
        return self.read(self.spark, self.path, self.block_rows, self.most_bytes)

    def append(self, rows: DataFrame, seq: int | None = None) -> Tree:
        """The index with (vec_id, vec) rows added: each goes down to its cell, radii on its way grow to hold it.

        ``seq``: a number of the caller's for the batch, larger than those
        before; one that is there already changes nothing.
        """
        home, after = self._next()
        if seq is not None and seq < after:
            return self
        seq = after if seq is None else seq
        new = stage(rows.select("vec_id", "vec"), "tree-new").filter("vec is not null")
        zero = ~F.exists("vec", lambda x: x != 0)
        at = new.withColumn("node", F.when(zero, ZERO).otherwise(ROOT).cast("bigint"))
        done = [at.filter(F.col("node") == ZERO).select("vec_id", "vec", "node")]
        grown = []
        open_ = at.filter(F.col("node") == ROOT).select("vec_id", "vec", "node")
        while not self.rootless:
            moved = stage(_at_nodes(open_, self.kids, self.sent, _assign, _ASSIGNED, "vec_id"), "tree-moved")
            grown.append(moved.groupBy("node").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")))
            done.append(moved.filter("leaf").select("vec_id", "vec", "node"))
            open_ = moved.filter("not leaf").select("vec_id", "vec", "node")
            if open_.isEmpty():
                break
        # A root that is the only cell keeps what comes until it is compacted.
        if self.rootless:
            done.append(open_)
        radii = self.spark.createDataFrame([(ZERO, math.pi, 0), (ROOT, math.pi, 0)], RADII)
        for g in grown:
            radii = radii.unionByName(g.select("node", "radius", "n"))
        members = done[0]
        for d in done[1:]:
            members = members.unionByName(d)
        radii.write.mode("overwrite").parquet(f"{home}/radii/seq={seq}")
        members.hint("rebalance", "node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{home}/members/seq={seq}")
        return self._close(home, seq, "append", new.count())

    def remove(self, ids: DataFrame) -> Tree:
        """The index without the vectors whose ``vec_id`` is in ``ids``; later batches can bring them back."""
        home, seq = self._next()
        ids.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct().write.mode("overwrite").parquet(f"{home}/removed/seq={seq}")
        return self._close(home, seq, "remove", self.spark.read.parquet(f"{home}/removed/seq={seq}").count())

    def clear(self) -> Tree:
        home, seq = self._next()
        return self._close(home, seq, "clear", 0)

    def changed_share(self) -> float:
        """Rows added and removed since the build, as a share of what it had."""
        home, _ = self._home(self.spark, self.path)
        rows = self.spark.read.schema(BATCHES).parquet(f"{home}/batches/*").collect()
        built = sum(r["rows"] for r in rows if r["kind"] == "build")
        cleared = any(r["kind"] == "clear" for r in rows)
        return math.inf if cleared else sum(r["rows"] for r in rows if r["kind"] != "build") / max(1, built)

    def compacted(self, share: float = MERGE_SHARE, cell_rows: int = CELL_ROWS, branch: int = BRANCH) -> Tree:
        """The next version, built from what is alive, if more than ``share`` has changed; else the index as it is."""
        if self.changed_share() <= share:
            return self
        _, version = self._home(self.spark, self.path)
        alive = stage(self.members.select("vec_id", "vec"), "tree-alive")
        nodes, radii, members, _ = self._grow(alive, cell_rows, branch, self.most_bytes)
        return self._write(self.spark, self.path, version + 1, nodes, radii, members, self.block_rows, self.most_bytes)

    def only(self, ids: DataFrame) -> Tree:
        """The same cells with just the vectors whose ``vec_id`` is in ``ids``; their radii still bound."""
        kept = self.members.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        return Tree(self.nodes, self.radii, stage(kept.select("vec_id", "vec", "node"), "tree-members"), self.block_rows, self.most_bytes, single=self.rootless)

    # ----------------------------------------------------------- searching

    def visits(self, q: DataFrame, nearest_only: bool = False, side: int | None = None) -> DataFrame:
        """(qid, bundle, mask): the bundles, and in each the cells by their bits, where a score above the query's bound (an angle) is possible.

        ``nearest_only``: one cell each. A query may have several rows for a bundle, with different cells.
        ``side``: see :meth:`bundles`.
        """
        cells, listed = self.bundles(side)
        if self.rootless:
            found = None
        elif self.sent is not None and listed is not None:
            place = sorted((r["node"], r["bundle"], r["bit"]) for r in listed)
            shared = self.spark.sparkContext.broadcast((self.sent, *(np.array(x, dtype=np.int64) for x in zip(*place))))

            def go(batches):
                kids, node, bundle, bit = shared.value
                numbers, at_bundle = np.unique(bundle, return_inverse=True)
                # What is held is a row number and a cell for each visit of a piece.
                step = max(64, min(ROUTED, VISITS_HELD // max(1, len(node))))
                for batch in batches:
                    batch = valid(batch)
                    for a in range(0, batch.num_rows, step):
                        piece = batch.slice(a, step)
                        rows, to = _ways_down(kids, matrix(piece.column("vec")), piece.column("bound").to_numpy(), nearest_only)
                        cell = np.searchsorted(node, to)
                        # Cells without rows are not among them.
                        known = node[np.minimum(cell, len(node) - 1)] == to
                        rows, cell = rows[known], cell[known]
                        key = rows * len(numbers) + at_bundle[cell]
                        order = np.argsort(key, kind="stable")
                        key, first = np.unique(key[order], return_index=True)
                        if len(key):
                            mask = np.bitwise_or.reduceat(np.int64(1) << bit[cell[order]], first)
                            yield pa.RecordBatch.from_arrays(
                                [piece.column("qid").take(pa.array(key // len(numbers))), pa.array(numbers[key % len(numbers)]), pa.array(mask)],
                                names=["qid", "bundle", "mask"])

            found = q.select("qid", "vec", "bound").mapInArrow(go, _VISITS)
        else:
            kids = stage(self.kids, "tree-kids") if self.sent is not None else self.kids
            ends = None
            at = q.filter("vec is not null").select("qid", "vec", "bound", F.lit(ROOT).cast("bigint").alias("node"))
            while True:
                met = stage(_at_nodes(at, kids, None, _descend(nearest_only), _VISITING, "qid"), "visiting")
                leaves = met.filter("leaf").select("qid", "node")
                ends = leaves if ends is None else ends.unionByName(leaves)
                at = met.filter("not leaf").select("qid", "vec", "bound", "node")
                if at.isEmpty():
                    break
            found = ends.join(cells, "node").groupBy("qid", "bundle").agg(F.bit_or(_bit()).alias("mask"))
        if self.loose:
            always = cells.filter(F.col("node").isin(self.loose)).groupBy("bundle").agg(F.bit_or(_bit()).alias("mask"))
            # At most two cells.
            loose = q.filter("vec is not null").select("qid").crossJoin(F.broadcast(always)).select("qid", "bundle", "mask")
            found = loose if found is None else found.unionByName(loose)
        return stage(found, "visits")

    def sides(self, visits: DataFrame, q: DataFrame, *more: str, side: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides, visits with the vectors (and columns ``more``) of ``q``, and the key: bounded numbers of rows have the same."""
        packed = self.bundles(side)[0]
        cells = broadcast_if_small(packed)
        crowd = visits.groupBy("bundle").agg(F.count(F.lit(1)).alias("asked"))
        plan = packed.select("bundle", "parts").distinct().join(crowd, "bundle").select(
            "bundle", "parts", F.ceil(F.col("asked") / (side or self.block_rows)).cast("int").alias("qparts"))
        plan = broadcast_if_small(stage(plan, "blocks"))
        asking = q.select(*[F.col(c).alias(c) for c in ("qid", "vec", *more)])
        left = (
            visits.join(plan, "bundle").join(asking, "qid")
            .withColumn("qpart", F.expr("pmod(xxhash64(qid), qparts)").cast("int"))
            .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
            .select("bundle", "part", "qpart", "qid", "vec", "mask", *more))
        right = (
            self.members.join(cells.select("node", "bundle", "bit"), "node").join(plan, "bundle")
            .withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)").cast("int"))
            .withColumn("qpart", F.explode(F.expr("sequence(0, qparts - 1)"))))
        keys = ["bundle", "part", "qpart"]
        # Renamed, as the queries may come from the members themselves.
        kept = [c for c in self.members.columns if c not in ("vec_id", "vec", "node")]
        return left, right.select(*[F.col(c).alias(c) for c in [*keys, "vec_id", "vec", "bit", *kept]]), keys

    def scan(self, visits: DataFrame, q: DataFrame, k: int, threshold: float | None, side: int | None = None) -> DataFrame:
        """(qid, vec_id, sim): k best of every block of cells and their visitors; ``q`` may have ``low``, a score its k-th best reaches."""
        more = ["low"] if "low" in q.columns else []

        def score(one: pa.Table, other: pa.Table) -> pa.Table:
            if one.num_rows == 0 or other.num_rows == 0:
                return FOUND.empty_table()
            low = one.column("low").to_numpy() if more else None
            best = Best(one.column("qid").to_numpy(), matrix(one.column("vec")), k, threshold, low)
            for rows, cell in meeting(one, other):
                best.add(cell.column("vec_id").to_numpy(), matrix(cell.column("vec")), rows)
            return found_table(best.found())

        left, right, keys = self.sides(visits, q, *more, side=side)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, FOUND_DDL)

    def search(self, q: DataFrame, k: int, threshold: float | None) -> DataFrame:
        """(qid, vec_id, sim): candidates among which each query's k best are; ``q``: (qid, vec), written out."""
        q = q.filter("vec is not null")
        if self.empty:
            return q.sparkSession.createDataFrame([], FOUND_DDL)
        if self.rootless:
            return self.scan(self.visits(q.withColumn("bound", F.lit(math.pi))), q, k, threshold)
        side = self.wide(q.count())
        if threshold is not None:
            bounded = q.withColumn("bound", F.lit(math.acos(max(-1.0, min(1.0, threshold - SLACK)))))
            return self.scan(self.visits(bounded, side=side), q, k, threshold, side)
        # The k-th score in the nearest cell is a floor for the final k-th score.
        probe = self.scan(self.visits(q.withColumn("bound", F.lit(math.pi)), nearest_only=True, side=side), q, k, None, side)
        low = keep_best(probe, k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
        # Fewer than k there: no floor, every cell is visited.
        angle = F.when(F.col("n") == k, F.acos(F.greatest(F.lit(-1.0), F.col("low") - SLACK)))
        bounded = q.join(stage(low, "floor"), "qid", "left").select(
            "qid", "vec", F.coalesce(angle, F.lit(math.pi)).alias("bound"), F.when(F.col("n") == k, F.col("low")).alias("low"))
        bounded = stage(bounded, "bounded")
        return self.scan(self.visits(bounded, side=side), bounded, k, None, side)
