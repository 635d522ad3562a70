"""Hard negatives by inner product from cover trees over norm-augmented vectors.

Every vector gets one more component that brings it to the largest norm of all,
so all lie on one sphere, and an anchor's inner product with a vector falls
with the angle between them. A cover tree has nested nets of centres, each
level finer than the one above, and for each node the largest angle to anything
below it. By that covering radius an anchor's products with all below a node
lie between two numbers.

A trunk of at most ``MAX_CELLS`` nodes is fitted on a bounded sample and every
vector is placed under its nearest bottom node; radii are those of all
vectors, so the sample changes nothing but the work. A cell is cut into parts
of bounded rows, and a task grows the tree of its part. An anchor visits the
cells whose bounds reach a window, level by level; inside a part it descends
best first, leaves out nodes outside its windows or below its k-th best, and
takes exact products in the leaves. Anchors meet parts in blocks of bounded
rows on either side.

Two searches make the result: an anchor's best of its own label (a first visit
to its nearest cell gives the bound), then, for the windows these open, its
best of other labels.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; a shorter vector ends in zeros; rows that repeat, or
share a vec_id, are rows of their own, so all but the anchor's own row can be
its positives; a null vec_id is no anchor and comes last among ties; products
are exact below 2**53; a negative positive score opens no window; columns not
named here are not read; very long vectors make parts of fewer rows; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import spread, stage
from .common import settle
from .vectors import FIT_BYTES, numbers, sample, sound

MAX_CELLS = 1_024
PART_ROWS = 8_192
PART_BYTES = 32 << 20
ANCHOR_ROWS = 2_048
LEAF_ROWS = 48
FIT_ROWS = 10_000
SHRINK = 1.3  # radius of a level by that of the next
SLACK = 1e-6  # of the largest possible product: far above the rounding of an angle
BEST = 9.2e18

_FOUND = pa.schema([("q", pa.int64()), ("j", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "q bigint, j int, row bigint, vec_id bigint, score bigint"


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of up to ``most`` unit vectors, each the farthest from those before, and its angle to them."""
    if len(x) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    chosen, gaps = [0], [math.pi]
    near = x @ x[0]
    while len(chosen) < most:
        i = int(near.argmin())
        if near[i] >= 1 - 1e-12:
            break
        chosen.append(i)
        gaps.append(math.acos(max(-1.0, near[i])))
        near = np.maximum(near, x @ x[i])
    return np.array(chosen), np.array(gaps)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class CoverTree:
    """Nested nets: level l has the first ``sizes[l]`` centres, a node's parent is the nearest centre one level up."""

    def __init__(self, centres: np.ndarray, gaps: np.ndarray):
        self.centres = centres
        sizes, radius = {1, len(centres)}, float(gaps[1]) if len(gaps) > 1 else 0.0
        while len(gaps) > 1 and radius > gaps[-1] > 0:
            sizes.add(int((gaps > radius).sum()))
            radius /= SHRINK
        self.sizes = sorted(sizes)
        self.parent = [np.zeros(1, dtype=np.int64)]
        for above, size in zip(self.sizes, self.sizes[1:]):
            self.parent.append(_angles(centres[:size], centres[:above]).argmin(axis=1))
        self.radius: list[np.ndarray] = []

    def children(self) -> list[list[list[int]]]:
        out = []
        for level, size in enumerate(self.sizes[:-1]):
            kids: list[list[int]] = [[] for _ in range(size)]
            for child, parent in enumerate(self.parent[level + 1].tolist()):
                kids[parent].append(child)
            out.append(kids)
        return out

    def cover(self, leaf_radius: np.ndarray) -> None:
        """Radii of all levels from those of the bottom nodes (-1: nothing below)."""
        radii = [leaf_radius]
        for level in range(len(self.sizes) - 1, 0, -1):
            below = radii[0]
            reach = np.full(self.sizes[level - 1], -1.0)
            to = self.parent[level]
            away = np.arccos(np.clip((self.centres[:self.sizes[level]] * self.centres[to]).sum(axis=1), -1, 1))
            full = below >= 0
            np.maximum.at(reach, to[full], (away + below)[full])
            radii.insert(0, reach)
        self.radius = radii

    def bounds(self, angles: np.ndarray, most: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product with what lies below each node of a level; ``most``: norm of anchor times norm of all."""
        radius = self.radius[level][None, :]
        at = angles[:, :self.sizes[level]]
        slack = SLACK * most[:, None]
        high = most[:, None] * np.cos(np.maximum(0, at - radius)) + slack
        low = most[:, None] * np.cos(np.minimum(math.pi, at + radius)) - slack
        return np.where(radius < 0, math.inf, low), np.where(radius < 0, -math.inf, high)

    def reached(self, angles: np.ndarray, most: np.ndarray, lows: list, highs: list) -> np.ndarray:
        """Bottom nodes (anchors x nodes) that no level rules out for every window of the anchor."""
        alive = np.ones((len(angles), 1), dtype=bool)
        for level in range(len(self.sizes)):
            low, high = self.bounds(angles, most, level)
            met = np.zeros(low.shape, dtype=bool)
            for lo, hi in zip(lows, highs):
                met |= (high >= lo[:, None]) & (low <= hi[:, None])
            alive = alive[:, self.parent[level]] & met
        return alive


class Sphere:
    """Vectors scaled by the largest component and brought to one norm by one more component."""

    def __init__(self, width: int, scale: float, norm: float):
        self.width, self.scale, self.norm = width, scale or 1.0, norm or 1.0

    def lift(self, m: np.ndarray) -> np.ndarray:
        m = m / self.scale
        rest = np.sqrt(np.maximum(0, self.norm ** 2 - (m * m).sum(axis=1, keepdims=True)))
        return np.hstack([m, rest]) / self.norm

    def aim(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors as unit vectors of the sphere's space (no extra component), and the largest product each can have."""
        m = m / self.scale
        size = np.sqrt((m * m).sum(axis=1))
        unit = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)
        return np.hstack([unit, np.zeros((len(m), 1))]), size * self.norm * self.scale ** 2


class _Part:
    """The tree of one part and its rows in order of leaves."""

    def __init__(self, rows: pa.Table, sphere: Sphere):
        ids = rows.column("row").to_numpy()
        order = np.argsort(ids)
        vec = numbers(rows.column("vec"), sphere.width)[order]
        on = sphere.lift(vec)
        chosen, gaps = farthest_first(on, max(1, math.ceil(len(on) / LEAF_ROWS)))
        self.tree = CoverTree(on[chosen], gaps)
        angle = _angles(on, on[chosen])
        leaf = angle.argmin(axis=1)
        radius = np.full(len(chosen), -1.0)
        np.maximum.at(radius, leaf, angle[np.arange(len(on)), leaf])
        self.tree.cover(radius)
        self.kids = self.tree.children()
        by = np.argsort(leaf, kind="stable")
        self.start = np.searchsorted(leaf[by], np.arange(len(chosen) + 1))
        self.vec, self.row = vec[by], ids[order][by]
        self.label = rows.column("label").to_numpy()[order][by]
        told = rows.column("vec_id").combine_chunks() if isinstance(rows.column("vec_id"), pa.ChunkedArray) else rows.column("vec_id")
        self.known = told.is_valid().to_numpy(zero_copy_only=False)[order][by]
        # A null id comes last.
        self.vec_id = np.where(self.known, told.fill_null(0).to_numpy(zero_copy_only=False)[order][by], np.iinfo(np.int64).max)

    def search(self, at: int, vec: np.ndarray, allowed, lows, highs, bounds, k: int):
        """Indices and scores of the k best rows of each window, best first."""
        last = len(self.tree.sizes) - 1
        best: list[list[tuple]] = [[] for _ in lows]
        need = list(lows)
        heap = [(-bounds[0][1][at, 0], 0, 0)]
        batch_size = 1
        while heap:
            batch = []
            while heap and len(batch) < batch_size:
                up, level, node = heapq.heappop(heap)
                up = -up
                if up < min(need):
                    heap = []
                    break
                low = bounds[level][0][at, node]
                if not any(up >= n and low <= hi for n, hi in zip(need, highs)):
                    continue
                if level == last:
                    batch.append(node)
                else:
                    for child in self.kids[level][node]:
                        heapq.heappush(heap, (-bounds[level + 1][1][at, child], level + 1, child))
            if not batch:
                continue
            batch_size = min(32, 2 * batch_size)
            where = np.concatenate([np.arange(self.start[n], self.start[n + 1]) for n in batch])
            where = where[allowed(where)]
            scores = self.vec[where] @ vec
            for j, (lo, hi) in enumerate(zip(need, highs)):
                can = np.flatnonzero((scores >= lo) & (scores <= hi))
                if len(can) > 4 * k:
                    floor = np.partition(scores[can], len(can) - k)[len(can) - k]
                    can = can[scores[can] >= floor]
                if len(can):
                    met = [(-scores[i], self.vec_id[where[i]], self.row[where[i]], where[i]) for i in can.tolist()]
                    best[j] = heapq.nsmallest(k, best[j] + met)
                    if len(best[j]) == k:
                        need[j] = max(lo, -best[j][-1][0])
        return best


def _search_block(left: pa.Table, right: pa.Table, sphere: Sphere, k: int, same: bool) -> pa.Table:
    if left.num_rows == 0 or right.num_rows == 0:
        return _FOUND.empty_table()
    part = _Part(right, sphere)
    vec = numbers(left.column("vec"), sphere.width)
    aimed, most = sphere.aim(vec)
    angles = _angles(aimed, part.tree.centres)
    bounds = [part.tree.bounds(angles, most, level) for level in range(len(part.tree.sizes))]
    q, labels = left.column("q").to_numpy(), left.column("label").to_numpy()
    lows, highs = left.column("lows").to_pylist(), left.column("highs").to_pylist()
    out = []
    for i in range(len(q)):
        if same:
            def allowed(w, i=i):
                return (part.label[w] == labels[i]) & (part.row[w] != q[i])
        else:
            def allowed(w, i=i):
                return part.label[w] != labels[i]
        for j, found in enumerate(part.search(i, vec[i], allowed, lows[i], highs[i], bounds, k)):
            out += [(int(q[i]), j, int(part.row[at]), int(part.vec_id[at]) if part.known[at] else None, int(max(-BEST, min(BEST, -s))))
                    for s, _, _, at in found]
    if not out:
        return _FOUND.empty_table()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)


class Candidates:
    """All vectors placed under the bottom nodes of the trunk."""

    def __init__(self, rows: DataFrame, part_rows: int, fit_rows: int):
        """``rows``: row, vec_id, label, vec (whole numbers)."""
        self.spark = rows.sparkSession
        facts = rows.agg(
            F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width"), F.count(F.lit(1)).alias("n"),
            F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("scale")).first()
        scale = facts["scale"] or 1.0
        squares = F.aggregate("vec", F.lit(0.0), lambda t, x: t + (x / scale) * (x / scale))
        norm = math.sqrt(rows.agg(F.max(squares)).first()[0] or 0.0)
        self.sphere = sphere = Sphere(max(1, facts["width"]), scale, norm)
        self.part_rows = max(1, min(part_rows, PART_BYTES // (8 * sphere.width)))
        drawn = sphere.lift(sample(rows, "row", "vec", sphere.width, fit_rows, FIT_BYTES))
        chosen, gaps = farthest_first(drawn, min(MAX_CELLS, max(1, math.ceil(facts["n"] / self.part_rows))))
        if not len(chosen):
            drawn, chosen, gaps = sphere.lift(np.zeros((1, sphere.width))), np.array([0]), np.array([math.pi])
        self.trunk = CoverTree(drawn[chosen], gaps)
        centres = self.trunk.centres

        def place(batches):
            for batch in batches:
                angle = _angles(sphere.lift(numbers(batch.column(3), sphere.width)), centres)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])],
                    names=["row", "vec_id", "label", "vec", "cell", "away"])

        placed = spread(rows.select("row", "vec_id", "label", "vec")).mapInArrow(
            place, "row bigint, vec_id bigint, label bigint, vec array<double>, cell int, away double")
        self.placed = stage(placed, "candidates")
        # At most MAX_CELLS rows.
        cells = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
        self.size = {r["cell"]: r["n"] for r in cells}
        radius = np.full(len(centres), -1.0)
        for r in cells:
            radius[r["cell"]] = r["r"]
        self.trunk.cover(radius)

    def visits(self, asked: DataFrame, nearest_only: bool) -> DataFrame:
        """(q, cell): cells whose bounds reach a window of the anchor, or only that of its nearest centre."""
        sphere, trunk = self.sphere, self.trunk

        def go(batches):
            for batch in batches:
                aimed, most = sphere.aim(numbers(batch.column(1), sphere.width))
                angles = _angles(aimed, trunk.centres)
                if nearest_only:
                    rows, cols = np.arange(len(angles)), np.where(trunk.radius[-1][None, :] < 0, math.inf, angles).argmin(axis=1)
                else:
                    lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                    deep = max((len(x) for x in lows), default=0)
                    # An anchor with fewer windows has empty ones.
                    lo = [np.array([x[w] if w < len(x) else math.inf for x in lows]) for w in range(deep)]
                    hi = [np.array([x[w] if w < len(x) else -math.inf for x in highs]) for w in range(deep)]
                    if not deep:
                        continue
                    rows, cols = np.nonzero(trunk.reached(angles, most, lo, hi))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cols.astype(np.int32))], names=["q", "cell"])

        return stage(spread(asked.select("q", "vec", "lows", "highs")).mapInArrow(go, "q bigint, cell int"), "visits")

    def search(self, asked: DataFrame, k: int, same: bool, nearest_only: bool = False) -> DataFrame:
        """(q, j, row, vec_id, score, rank): the k best rows of window j, of the anchor's label or of others.

        ``asked``: q, label, vec, lows, highs; window j holds scores from
        lows[j] to highs[j].
        """
        visits = self.visits(asked, nearest_only)
        crowd = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(c, math.ceil(n / self.part_rows), math.ceil(crowd[c] / ANCHOR_ROWS)) for c, n in self.size.items() if c in crowd]
        # At most MAX_CELLS rows.
        parts = F.broadcast(self.spark.createDataFrame(plan, "cell int, parts int, qparts int"))
        left = (
            visits.join(parts, "cell").join(asked.select(F.col("q").alias("q"), "label", "vec", "lows", "highs"), "q")
            .withColumn("qpart", F.expr("pmod(xxhash64(q), qparts)").cast("int"))
            .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
            .select("cell", "part", "qpart", "q", "label", "vec", "lows", "highs"))
        right = (
            self.placed.join(parts, "cell")
            .withColumn("part", F.expr("pmod(xxhash64(row), parts)").cast("int"))
            .withColumn("qpart", F.explode(F.expr("sequence(0, qparts - 1)"))))
        keys = ["cell", "part", "qpart"]
        right = right.select(*[F.col(c).alias(c) for c in [*keys, "row", "vec_id", "label", "vec"]])
        sphere = self.sphere
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            lambda a, b: _search_block(a, b, sphere, k, same), _FOUND_DDL)
        best = Window.partitionBy("q", "j").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5),
    part_rows: int = PART_ROWS, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: vec_id, vec (whole numbers), label. An anchor is a row where
    ``anchor`` (on vec_id) holds. Its positives are the best of its label; a
    negative of another label scores at most its positive and at least ``low``
    (a fraction) of it.
    """
    settle(rows.sparkSession)
    vec = F.col("vec").cast("array<double>")
    given = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), vec.alias("vec")).filter(sound(F.col("vec")) & F.col("label").isNotNull())
    # Written once, so that row numbers stay what they are if a task is lost.
    rows = stage(given.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), "label", "vec"), "vectors")
    held = Candidates(rows, part_rows, fit_rows)
    asked = rows.filter(anchor & F.col("vec_id").isNotNull()).select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "vec")
    everything = asked.withColumns({"lows": F.array(F.lit(-math.inf)), "highs": F.array(F.lit(math.inf))})
    first = held.search(everything, positives, True, nearest_only=True).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floor = F.when(F.col("n") == positives, F.col("floor").cast("double")).otherwise(F.lit(-math.inf))
    bounded = everything.join(first, "q", "left").withColumn("lows", F.array(F.coalesce(floor, F.lit(-math.inf))))
    close = stage(held.search(stage(bounded.select("q", "label", "vec", "lows", "highs"), "asked"), positives, True), "positives")
    close = close.select("q", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # At most ``positives`` windows an anchor, in order of j.
    windows = close.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("j", "positive_score"))).alias("w"))
    score = [F.transform("w", lambda x: x["positive_score"].cast("double"))]
    up, down = low
    least = F.transform(score[0], lambda s: F.when(s >= 0, F.ceil(s * up / down).cast("double")).otherwise(F.lit(math.inf)))
    opened = stage(asked.join(windows, "q").select("q", "label", "vec", least.alias("lows"), score[0].alias("highs")), "windows")
    far = held.search(opened, negatives, False).select(
        "q", "j", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(close, ["q", "j"]).join(asked.select("q", "anchor_id"), "q").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
