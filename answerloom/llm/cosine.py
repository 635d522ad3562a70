"""Near copies among embeddings: PCA-ordered comparison of tiles.

Components are rotated so that those with most variance come first. Vectors
are sorted into cells by medians of the leading component that varies most, cells are cut
into tiles of bounded rows, and two cells are compared only where the boxes
around their leading components lie close enough. Inside a pair of tiles the
products of the leading components are summed first. What is left of a cosine
is at most the product of the two suffix norms (Cauchy-Schwarz); that product
is one more column of the same matrix product, so one comparison stops nearly
all pairs. The others take more components, block by block, under the same
bound, and what remains is decided on the whole vectors in double precision.

The rotation and the medians are fitted on a bounded sample (``fit_rows``).
They settle the order of the work only: every pair that is left out was proved
to lie below the threshold, so recall is 1 whatever the sample is.

Exact copies are one class with a count. A pair of tiles returns a spanning
forest and a sum of links per class, never pairs. Where no component carries
much more than others (random directions) hardly any pair of tiles is left
out and the work grows with the square of the classes; a vector then travels
once per tile.

Defined results: a null, zero or non-finite vector, or one with a null or
non-finite component, links with nothing; of vectors of different length the
shorter one ends in zeros; rows with one vec_id are rows of their own, and of a
group the smallest vec_id that is there is its id; a null id is kept where no
other id is in its group; columns not named here are not read; very long
vectors make tiles of fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread, stage
from .common import settle
from .components import components, unite
from .vectors import kept_type, numbers, sample, sound, unit

TILE_ROWS = 8_192
TILE_BYTES = 32 << 20
MAX_CELLS = 1_024
BOX_DIMS = 16
FIT_ROWS = 20_000
SCORES = 4_000_000  # bounds held at a time
EXACT_PAIRS = 65_536
BOUND_SLACK = 1e-9  # far above the rounding of a bound

_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_FOUND_DDL = "a bigint, b bigint, n bigint"


class Order:
    """Rotation to principal components, how many lead, and medians that sort vectors into cells."""

    def __init__(self, drawn: np.ndarray, width: int, threshold: float, cells: int):
        drawn = unit(drawn) if len(drawn) else drawn
        variance, axes = np.linalg.eigh(drawn.T @ drawn / max(1, len(drawn)))
        variance, self.axes = np.clip(variance[::-1], 0, None), axes[:, ::-1]
        # Pairs of unrelated vectors: what their leading products vary by, against what is missing to the threshold.
        rest = np.maximum(0, variance.sum() - np.cumsum(variance))
        spare = (threshold - rest) / np.sqrt(np.maximum(1e-300, np.cumsum(variance ** 2)))
        enough = np.flatnonzero((spare >= 3.5) | (rest <= 0.1 * variance.sum()))
        self.lead = int(enough[0]) + 1 if len(enough) else width
        self.levels = min(max(0, math.ceil(math.log2(max(1, cells)))), width)
        # Per level, for each cell so far: the component that varies most in it, and its median there.
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        at = (drawn @ self.axes)[:, :BOX_DIMS]
        code = np.zeros(len(at), dtype=np.int64)
        for _ in range(self.levels):
            dims, cuts = np.zeros(1 << len(self.cuts), dtype=np.int64), np.zeros(1 << len(self.cuts))
            for c in np.unique(code).tolist():
                mine = at[code == c]
                dims[c] = mine.var(axis=0).argmax()
                cuts[c] = np.median(mine[:, dims[c]])
            self.cuts.append((dims, cuts))
            code = self._split(at, code, dims, cuts)

    @staticmethod
    def _split(at: np.ndarray, code: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 2 * code + (at[np.arange(len(at)), dims[code]] > cuts[code])

    def cell(self, at: np.ndarray) -> np.ndarray:
        code = np.zeros(len(at), dtype=np.int64)
        for dims, cuts in self.cuts:
            code = self._split(at, code, dims, cuts)
        return code


def _close_cells(boxes: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs (a <= b) of cells whose boxes come as near as two linked unit vectors must."""
    ids = sorted({r["cell"] for r in boxes})
    place = {c: i for i, c in enumerate(ids)}
    dims = 1 + max((r["dim"] for r in boxes), default=0)
    lo, hi = np.zeros((len(ids), dims)), np.zeros((len(ids), dims))
    for r in boxes:
        lo[place[r["cell"]], r["dim"]], hi[place[r["cell"]], r["dim"]] = r["lo"], r["hi"]
    pairs = []
    for i, c in enumerate(ids):
        gap = np.maximum(0, np.maximum(lo[i] - hi[i:], lo[i:] - hi[i]))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * threshold + BOUND_SLACK)
        pairs += [(c, ids[i + j]) for j in near.tolist()]
    return pairs


def _linked(left: np.ndarray, right: np.ndarray, order: Order, threshold: float, same: bool):
    """Yields (rows, columns) of the pairs of unit vectors at or above the threshold."""
    a, b = left @ order.axes, right @ order.axes
    width, k = left.shape[1], order.lead

    def rest(m, at):
        return np.sqrt(np.maximum(0, (m[:, at:] ** 2).sum(axis=1)))

    cuts = sorted({min(width, k + (width - k + 3) // 4 * i) for i in range(1, 5)} - {k})
    suffix = [(c, rest(a, c), rest(b, c)) for c in [k, *cuts]]
    wide_a, wide_b = np.c_[a[:, :k], suffix[0][1]], np.c_[b[:, :k], suffix[0][2]]
    least = threshold - BOUND_SLACK
    step = max(1, SCORES // max(1, len(right)))
    for at in range(0, len(left), step):
        first = at if same else 0
        bound = wide_a[at:at + step] @ wide_b[first:].T
        rows, cols = np.nonzero(bound >= least)
        if same:
            later = cols > rows
            rows, cols = rows[later], cols[later]
        rows, cols = rows + at, cols + first
        for i in range(0, len(rows), EXACT_PAIRS):
            r, c = rows[i:i + EXACT_PAIRS], cols[i:i + EXACT_PAIRS]
            so_far = np.einsum("ij,ij->i", a[r, :k], b[c, :k])
            done = k
            for cut, ra, rb in suffix[1:]:
                so_far = so_far + np.einsum("ij,ij->i", a[r, done:cut], b[c, done:cut])
                can = so_far + ra[r] * rb[c] >= least
                r, c, so_far, done = r[can], c[can], so_far[can], cut
            sure = np.einsum("ij,ij->i", left[r], right[c]) >= threshold
            if sure.any():
                yield r[sure], c[sure]


def _tile_links(left: pa.Table, right: pa.Table, width: int, order: Order, threshold: float, same: bool) -> pa.Table:
    """Per class its links in the other tile, and edges (smallest, member) that join what is linked."""
    if left.num_rows == 0 or right.num_rows == 0:
        return _FOUND.empty_table()
    ids_l, ids_r = left.column("rep").to_numpy(), right.column("rep").to_numpy()
    n_l, n_r = left.column("n").to_numpy(), right.column("n").to_numpy()
    a, b = unit(numbers(left.column("vec"), width)), unit(numbers(right.column("vec"), width))
    if same:
        # Both sides hold the same rows, maybe in another order.
        at = np.argsort(ids_l)
        ids_l = ids_r = ids_l[at]
        n_l = n_r = n_l[at]
        a = b = a[at]
    ids, inverse = np.unique(np.concatenate([ids_l, ids_r]), return_inverse=True)
    li, ri = inverse[:len(ids_l)], inverse[len(ids_l):]
    label = np.arange(len(ids))
    links = np.zeros(len(ids), dtype=np.int64)
    for rows, cols in _linked(a, b, order, threshold, same):
        np.add.at(links, li[rows], n_r[cols])
        np.add.at(links, ri[cols], n_l[rows])
        label = unite(label, li[rows], ri[cols])
    moved, met = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
    none = pa.nulls(len(met), pa.int64())
    return pa.concat_tables([
        pa.table([pa.array(ids[met]), none, pa.array(links[met])], schema=_FOUND),
        pa.table([pa.array(ids[label[moved]]), pa.array(ids[moved]), pa.nulls(len(moved), pa.int64())], schema=_FOUND),
    ])


def near_copies(
    vectors: DataFrame, threshold: float = 0.9, *, id_col: str = "vec_id", vec_col: str = "embedding",
    tile_rows: int = TILE_ROWS, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (see the module for edge rows)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and at most at 1")
    spark = settle(vectors.sparkSession)
    vec = kept_type(vectors, vec_col)
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), vec.alias("vec"))
    usable = sound(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    # Written once, so that row numbers stay what they are if a task is lost.
    rows = stage(given.withColumn("vec", F.when(usable, F.col("vec"))), "vectors")
    classes = stage(rows.filter("vec is not null").groupBy("vec").agg(
        F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")), "classes")
    size = classes.agg(F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = size["width"]
    tile = max(1, min(tile_rows, TILE_BYTES // (8 * width)))
    order = Order(sample(classes, "rep", "vec", width, fit_rows), width, threshold, min(MAX_CELLS, math.ceil(size["n"] / tile)))
    dims = min(BOX_DIMS, width)

    def place(batches):
        for batch in batches:
            at = unit(numbers(batch.column(2), width)) @ order.axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(order.cell(at).astype(np.int32))],
                names=["rep", "n", "vec", "cell"])

    kind = dict(classes.dtypes)["vec"]
    placed = stage(spread(classes.select("rep", "n", "vec")).mapInArrow(place, f"rep bigint, n bigint, vec {kind}, cell int"), "placed")

    def box(batches):
        found: dict[int, list] = {}
        for batch in batches:
            at = (unit(numbers(batch.column(0), width)) @ order.axes)[:, :dims]
            cell = batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                mine = at[cell == c]
                now = found.get(c)
                lo, hi, n = mine.min(axis=0), mine.max(axis=0), len(mine)
                found[c] = [lo, hi, n] if now is None else [np.minimum(lo, now[0]), np.maximum(hi, now[1]), n + now[2]]
        for c, (lo, hi, n) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(lo), pa.array(hi), pa.array([n] * dims, pa.int64())],
                names=["cell", "dim", "lo", "hi", "n"])

    # At most MAX_CELLS * BOX_DIMS rows.
    boxes = placed.select("vec", "cell").mapInArrow(box, "cell int, dim int, lo double, hi double, n bigint").groupBy("cell", "dim").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    parts = {r["cell"]: math.ceil(r["n"] / tile) for r in boxes}
    plan = spark.createDataFrame(
        [(a, b, parts[a], parts[b]) for a, b in _close_cells(boxes, threshold)], "ca int, cb int, pa int, pb int")
    # At most MAX_CELLS * (MAX_CELLS + 1) / 2 narrow rows.
    plan = F.broadcast(plan)
    part = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")
    keys = ["ca", "cb", "p", "q"]
    left = placed.join(plan, F.col("cell") == F.col("ca")).withColumn("own", F.col("pa")).withColumn("p", part).withColumn(
        "q", F.explode(F.expr("sequence(if(ca = cb, p, 0), pb - 1)")))
    right = placed.join(plan, F.col("cell") == F.col("cb")).withColumn("own", F.col("pb")).withColumn("q", part).withColumn(
        "p", F.explode(F.expr("sequence(0, if(ca = cb, q, pa - 1))")))

    def compare(key, one: pa.Table, other: pa.Table) -> pa.Table:
        ca, cb, p, q = (k.as_py() for k in key)
        return _tile_links(one, other, width, order, threshold, ca == cb and p == q)

    columns = [*keys, "rep", "n", "vec"]
    # Renamed, as both sides come from the same tables.
    right = right.select(*[F.col(c).alias(c) for c in columns])
    met = left.select(*columns).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, _FOUND_DDL)
    found = stage(met, "links")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = (
        classes.select("rep", "n", "low").join(links, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("group", F.coalesce("group_id", "rep")))
    grouped = stage(grouped.select("rep", "group", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "grouped")
    smallest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    told = stage(grouped.join(smallest, "group").select("rep", "n_links", "component_id"), "told")
    # The unique sides are written out, so that a crowded one can be split.
    member = stage(rows.filter("vec is not null").join(classes.select("vec", "rep"), "vec").select("vec_id", "rep"), "members")
    alone = rows.filter("vec is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = member.join(told, "rep").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
