"""Near copies and hard negatives of embeddings against brute force."""

import math

import brute
import numpy as np
import pytest
from answerloom.llm import cosine, covertree
from answerloom.llm.common import settle
from answerloom.llm.components import unite
from pyspark.sql import functions as F

ROWS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def spark(spark):
    return settle(spark)


def clustered(seed, n, dims, crowd):
    """Random directions, a crowd around one of them, exact and scaled copies, and pairs near the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * np.linspace(2, 0.3, dims)
    x[:crowd] = x[0] + rng.normal(size=(crowd, dims)) * 0.25
    x[crowd:crowd + 5] = x[crowd]
    x[crowd + 5:crowd + 8] = x[crowd] * 3
    for i in range(crowd + 10, n - 1, 7):
        x[i + 1] = x[i] + rng.normal(size=dims) * np.linalg.norm(x[i]) * 0.484 / math.sqrt(dims)
    return x.astype(np.float32)


def want_links(rows, threshold):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    usable = []
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            usable.append(i)
    links, label = [0] * len(rows), list(range(len(rows)))
    width = max([len(rows[i][1]) for i in usable], default=1)
    m = np.zeros((len(usable), width))
    for k, i in enumerate(usable):
        m[k, :len(rows[i][1])] = np.array(rows[i][1], dtype=np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True) if len(m) else 1
    for i in range(len(usable)):
        for j in np.flatnonzero(m[i] @ m.T >= threshold).tolist():
            if j != i:
                links[usable[i]] += 1
                a, b = sorted((brute.root(label, usable[i]), brute.root(label, usable[j])))
                label[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(brute.root(label, i), []).append(rows[i][0])
    out = []
    for i, (vec_id, _) in enumerate(rows):
        low = min([x for x in groups[brute.root(label, i)] if x is not None], default=None)
        out.append((vec_id, links[i], low, vec_id == low))
    return sorted(out, key=str)


def found_links(df, *args, **more):
    return sorted((tuple(r) for r in cosine.near_copies(df, *args, **more).collect()), key=str)


@pytest.mark.parametrize("seed,dims,tile,threshold", [(1, 12, 40, 0.9), (2, 64, 64, 0.9), (4, 8, 500, 0.7)])
def test_links_equal_all_pairs(spark, seed, dims, tile, threshold):
    x = clustered(seed, 400, dims, 60)
    rows = [(1000 - i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS)
    got = found_links(df, threshold, tile_rows=tile, fit_rows=100)
    assert got == want_links(rows, threshold)
    assert any(n for _, n, _, _ in got)


def test_distant_cells_are_not_compared():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8)) * np.array([3, 2, 1, .5, .1, .1, .1, .1])
    order = cosine.Order(x, 8, 0.9, 64)
    at = cosine.unit(x) @ order.axes
    cell = order.cell(at)
    boxes = [
        {"cell": int(c), "dim": d, "lo": at[cell == c, d].min(), "hi": at[cell == c, d].max()}
        for c in np.unique(cell) for d in range(8)]
    pairs = cosine._close_cells(boxes, 0.9)
    assert len(pairs) < 0.5 * 64 * 65 / 2
    linked = np.argwhere(np.triu(at @ at.T >= 0.9, 1))
    assert {tuple(sorted((int(cell[i]), int(cell[j])))) for i, j in linked} <= set(pairs)
    assert order.lead < 8


def test_edge_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (None, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [0.5, -1.0]), (2, [3e38, 3e38]), (0, [1e-30, 1e-30]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS).withColumns({c: F.lit("mine") for c in ("rep", "row", "n", "cell", "p", "vec", "kept")})
    assert found_links(df) == want_links(rows, 0.9)
    assert cosine.near_copies(df.limit(0)).count() == 0
    assert cosine.near_copies(df.filter("vec_id = 3")).collect()[0].kept


def test_unite_labels_are_smallest_indices():
    rng = np.random.default_rng(6)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    label = unite(np.arange(300), u, v)
    plain = list(range(300))
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = sorted((brute.root(plain, a), brute.root(plain, b)))
        plain[y] = x
    assert label.tolist() == [brute.root(plain, i) for i in range(300)]


# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id bigint, vec array<double>, label bigint"


def want_negatives(rows, every, positives, negatives):
    """(anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    use = [
        (i, v, x, label) for i, (v, x, label) in enumerate(rows)
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, v, x, label in use:
        if v is None or v % every:
            continue
        scored = sorted(
            (-int(sum(a * b for a, b in zip(x, y))), w if w is not None else 2**62, k, other) for k, w, y, other in use)
        mine = [s for s in scored if s[3] == label and s[2] != i][:positives]
        for s in mine:
            close = [t for t in scored if t[3] != label and 4 * -s[0] <= 5 * -t[0] and -t[0] <= -s[0]][:negatives]
            out += [(v, rows[s[2]][0], r, rows[t[2]][0], -s[0], -t[0]) for r, t in enumerate(close, 1)]
    return sorted(out, key=str)


def mined(df, every, *args, **more):
    return sorted((tuple(r) for r in covertree.mine(df, F.col("vec_id") % every == 0, *args, **more).collect()), key=str)


@pytest.mark.parametrize("seed,dims,part,labels", [(1, 6, 50, 4), (2, 64, 400, 3), (3, 2, 30, 2)])
def test_negatives_equal_a_sort_of_all_rows(spark, seed, dims, part, labels):
    rng = np.random.default_rng(seed)
    x = np.floor(clustered(seed, 420, dims, 120) * 40)
    rows = [(int(i), [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = mined(df, 20, 4, 3, part_rows=part, fit_rows=100)
    assert got == want_negatives(rows, 20, 4, 3) and got


def test_edge_rows_of_mining(spark):
    rows = [
        (0, [2.0, 1.0], 1), (0, [2.0, 1.0], 1), (1, [3.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, [2.0], 2), (None, [2.0, 1.0], 2), (4, None, 1),
        (5, [1.0, None], 2), (6, [float("nan"), 1.0], 1), (7, [1.0, 1.0], None), (100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 2), (8, [1.0, 2.0], 2),
        (300, [], 3), (9, [float("inf"), 0.0], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("row", "cell", "q", "score", "anchor_id", "part")})
    assert mined(df, 100) == want_negatives(rows, 100, 5, 5)
    assert covertree.mine(df.limit(0), F.lit(True)).count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0], i % 2) for i in range(6)], VECTORS)
    assert mined(zeros, 2, 2, 2) == want_negatives([(i, [0.0, 0.0], i % 2) for i in range(6)], 2, 2, 2)


def test_bounds_hold_and_leave_nodes_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 5)) * 20
    x = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 5)))
    sphere = covertree.Sphere(5, np.abs(x).max(), np.linalg.norm(x / np.abs(x).max(), axis=1).max())
    on = sphere.lift(x)
    assert np.allclose(np.linalg.norm(on, axis=1), 1)
    chosen, gaps = covertree.farthest_first(on, 40)
    tree = covertree.CoverTree(on[chosen], gaps)
    angle = covertree._angles(on, on[chosen])
    leaf = angle.argmin(axis=1)
    radius = np.full(len(chosen), -1.0)
    np.maximum.at(radius, leaf, angle.min(axis=1))
    tree.cover(radius)
    assert len(tree.sizes) > 2 and tree.sizes[0] == 1
    anchors = x[::90]
    aimed, most = sphere.aim(anchors)
    scores = anchors @ x.T
    under = leaf
    for level in range(len(tree.sizes) - 1, -1, -1):
        low, high = tree.bounds(covertree._angles(aimed, tree.centres), most, level)
        assert (scores <= high[:, under]).all() and (scores >= low[:, under]).all()
        if level:
            under = tree.parent[level][under]
    top = np.sort(scores, axis=1)[:, -5]
    met = tree.reached(covertree._angles(aimed, tree.centres), most, [top], [np.full(len(anchors), np.inf)])
    assert met.mean() < 0.5
    for i, j in np.argwhere(scores >= top[:, None]):
        assert met[i, leaf[j]]
