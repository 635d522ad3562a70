"""Levels of cells: bounds on their size, exact searches, changes to a saved index."""

import numpy as np
import pytest
from answerloom.plans import search, tree
from answerloom.plans.tree import Tree
from pyspark.sql import functions as F


def vectors(spark, n, dims, seed=1, crowd=0, first=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:crowd] = x[0] + rng.normal(size=(crowd, dims)) * 0.05
    rows = [(first + i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def best(queries, rows, k):
    """(qid, vec_id, sim, rank) by scoring everything, as search rounds and breaks ties."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = []
    for qid, v in queries:
        v = np.array(v) / max(np.linalg.norm(v), 1e-300)
        sims = np.rint(x @ v * 1e6) / 1e6 + 0.0
        order = np.lexsort((ids, -sims))[:k]
        out += [(qid, int(ids[i]), float(sims[i]), r) for r, i in enumerate(order, 1)]
    return sorted(out)


def found(df):
    return sorted((r.qid, r.vec_id, r.sim, r["rank"]) for r in df.collect())


def index(df):
    return search.side(df, "vec_id", "embedding", "vec_id")


@pytest.mark.parametrize("most_bytes", [0])
def test_tree_in_levels_is_exact(spark, most_bytes):
    rows, df = vectors(spark, 500, 6, crowd=150)
    rows += [(5000, [0.0] * 6), (5001, [0.0] * 6)]
    df = df.union(spark.createDataFrame(rows[-2:], df.schema)).union(spark.createDataFrame([(6000, None)], df.schema))
    queries, q = vectors(spark, 40, 6, seed=2, first=100)
    queries.append((7, [0.0] * 6))
    q = q.union(spark.createDataFrame(queries[-1:], q.schema)).toDF("qid", "embedding")
    built = Tree.build(index(df), cell_rows=30, branch=5, block_rows=64, most_bytes=most_bytes)
    sizes = {r.node: r.n for r in built.sizes.collect()}
    assert sum(sizes.values()) == 502 and sizes[tree.ZERO] == 2 and max(sizes.values()) <= 30
    depth = built.nodes.select("node", "parent").collect()
    up = {r.node: r.parent for r in depth}

    def levels(n):
        return 1 + levels(up[n]) if up[n] is not None else 0

    assert max(levels(n) for n in sizes) >= 3
    assert found(search.nearest(q, built, 4)) == best(queries, rows, 4)
    near = found(search.nearest(q, built, 4, 0.9))
    assert near == [r for r in best(queries, rows, 4) if r[2] >= 0.9] and near


def test_equal_vectors_stay_one_cell_and_are_cut_where_scored(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    built = Tree.build(index(df), cell_rows=16, branch=4, block_rows=32)
    assert max(r.n for r in built.sizes.collect()) == 300
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [40.0, 1.0, 0.0])], "qid bigint, embedding array<float>")
    assert found(search.nearest(q, built, 6)) == best([(1, [1.0, 2.0, 3.0]), (2, [40.0, 1.0, 0.0])], rows, 6)


def test_few_cells_are_visited_in_low_dimensions(spark):
    _, df = vectors(spark, 3_000, 3)
    built = Tree.build(index(df), cell_rows=30, branch=8)
    q = search.side(vectors(spark, 20, 3, seed=5)[1], "vec_id", "embedding", "qid").withColumn("bound", F.lit(0.1))
    assert built.visits(q).count() < 0.2 * 20 * built.sizes.count()


@pytest.mark.parametrize("most_bytes", [0])
def test_changes_equal_a_fresh_build(spark, tmp_path, most_bytes):
    rows, df = vectors(spark, 300, 5, crowd=60)
    queries, q = vectors(spark, 25, 5, seed=3)
    q = q.toDF("qid", "embedding")
    saved = Tree.build(index(df.filter("vec_id < 200")), str(tmp_path / "i"), cell_rows=50, branch=6, most_bytes=most_bytes)
    saved = saved.append(index(df.filter("vec_id >= 200"))).remove(df.filter("vec_id % 4 = 0").select("vec_id"))
    alive = [r for r in rows if r[0] % 4]
    saved = saved.append(index(df.filter("vec_id = 8")))
    alive.append(rows[8])
    again = Tree.read(spark, str(tmp_path / "i"), most_bytes=most_bytes)
    assert found(search.nearest(q, again, 5)) == best(queries, alive, 5)
    assert saved.changed_share() > 0.25
    merged = saved.compacted(cell_rows=25, branch=4)
    assert merged.changed_share() == 0 and found(search.nearest(q, merged, 5)) == best(queries, alive, 5)
    assert merged.compacted() is merged
    some = merged.only(spark.createDataFrame([(8,), (9,), (10,)], "vec_id bigint"))
    assert found(search.nearest(q, some, 5)) == best(queries, [r for r in alive if r[0] in (8, 9, 10)], 5)


def test_clearing_and_starting_from_nothing(spark, tmp_path):
    rows, df = vectors(spark, 30, 4)
    queries, q = vectors(spark, 5, 4, seed=3)
    q = q.toDF("qid", "embedding")
    saved = Tree.build(index(df), str(tmp_path / "i")).clear()
    assert search.nearest(q, saved, 3).count() == 0
    saved = saved.append(index(df.filter("vec_id < 9")))
    assert found(search.nearest(q, saved, 3)) == best(queries, rows[:9], 3)
    fresh = Tree.build(index(df.limit(0)), str(tmp_path / "n"))
    assert fresh.empty and search.nearest(q, fresh, 3).count() == 0
    fresh = fresh.append(index(df))
    assert found(search.nearest(q, fresh, 3)) == best(queries, rows, 3)
    assert found(search.nearest(q, fresh.compacted(), 3)) == best(queries, rows, 3)
    with pytest.raises(ValueError):
        Tree.build(index(df)).clear()


def test_a_batch_that_failed_is_not_seen(spark, tmp_path):
    rows, df = vectors(spark, 40, 4)
    saved = Tree.build(index(df.filter("vec_id < 20")), str(tmp_path / "i"))
    # Members without their row in batches: what a writer that died leaves behind.
    saved.members.limit(3).withColumn("vec_id", F.lit(999).cast("bigint")).write.parquet(str(tmp_path / "i" / "v1" / "members" / "seq=1"))
    assert Tree.read(spark, str(tmp_path / "i")).members.filter("vec_id = 999").count() == 0
    saved = saved.append(index(df.filter("vec_id >= 20")))
    assert sorted(r.vec_id for r in saved.members.collect()) == list(range(40))


def test_a_query_travels_once_to_cells_that_lie_together(spark):
    rows, df = vectors(spark, 600, 8)
    queries, q = vectors(spark, 30, 8, seed=2)
    built = Tree.build(index(df), cell_rows=20, branch=6, block_rows=200)
    sides = search.side(q, "vec_id", "embedding", "qid").withColumn("bound", F.lit(float(np.pi)))
    visits = built.visits(sides)
    cells = built.sizes.count()
    bundles = visits.select("bundle").distinct().count()
    assert cells > 40 and bundles <= 4
    assert visits.count() == 30 * bundles
    assert visits.agg(F.sum(F.bit_count("mask"))).first()[0] == 30 * cells
    assert found(search.nearest(q.toDF("qid", "embedding"), built, 4)) == best(queries, rows, 4)


@pytest.mark.parametrize("threshold", [None, 0.4])
def test_best_of_blocks_with_copies_and_floors(threshold):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5_000, 9))
    x[:2_000] = x[0]
    x[2_000:2_300] = x[0] + 1e-6 * rng.normal(size=(300, 9))
    x[2_300:2_310] = 0
    q = np.concatenate([x[:1], x[2_295:2_305], rng.normal(size=(700, 9))])
    x, q = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (x, q) for n in [np.linalg.norm(m, axis=1, keepdims=True)])
    ids = rng.permutation(5_000) * 2
    sims = np.rint(q @ x.T * 1e6) / 1e6 + 0.0
    wanted, low = [], []
    for i in range(len(q)):
        order = np.lexsort((ids, -sims[i]))[:7]
        low.append(sims[i, order[-1]] if i % 2 else np.nan)
        wanted += [(i, int(ids[j]), float(sims[i, j])) for j in order if threshold is None or sims[i, j] >= threshold]
    for given in (None, np.array(low)):
        met = search.Best(np.arange(len(q)), q, 7, threshold, given)
        for part in np.array_split(np.arange(5_000), 3):
            met.add(ids[part], x[part])
        assert sorted(zip(*(c.tolist() for c in met.found()))) == sorted(wanted)


def test_components_that_no_query_has_are_not_multiplied():
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(50, 12)), rng.normal(size=(3_000, 12))
    q[:, [2, 3, 7]] = 0
    q, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
    sims = np.rint(q @ x.T * 1e6) / 1e6 + 0.0
    wanted = [(i, int(j), float(sims[i, j])) for i in range(50) for j in np.lexsort((np.arange(3_000), -sims[i]))[:5]]
    # A row with what is no number, be it where no query has anything, is no query's best.
    x = np.concatenate([x, x[:1]])
    x[-1, 2] = np.nan
    met = search.Best(np.arange(50), q, 5)
    met.add(np.arange(3_001), x)
    assert met.single.shape == (50, 9)
    assert sorted(zip(*(c.tolist() for c in met.found()))) == sorted(wanted)
    nothing = search.Best(np.arange(2), np.zeros((2, 12)), 3)
    nothing.add(np.arange(3_000), x[:3_000])
    assert sorted(zip(*(c.tolist() for c in nothing.found()))) == [(i, j, 0.0) for i in range(2) for j in range(3)]


def test_ways_down_hold_no_vectors_per_visit():
    """Two levels of 64 branches that all have to be entered: what is held is a row number and a cell per visit."""
    import tracemalloc

    rng = np.random.default_rng(6)
    kids = {tree.ROOT: tree._Kids([{"node": 64 + i, "vec": rng.normal(size=64), "radius": np.pi, "leaf": False} for i in range(64)])}
    for n in range(64, 128):
        kids[n] = tree._Kids([{"node": n * 64 + i, "vec": rng.normal(size=64), "radius": np.pi, "leaf": True} for i in range(4)])
    m = rng.normal(size=(1_000, 64))
    tracemalloc.start()
    rows, to = tree._ways_down(kids, m / np.linalg.norm(m, axis=1, keepdims=True), np.full(1_000, np.pi), False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == len(to) == 1_000 * 256 and peak < 40 * len(rows)


def test_pairs_of_classes_are_not_written_and_keep_their_sizes(spark, monkeypatch):
    from answerloom.operators import similarity

    x = np.random.default_rng(9).normal(size=(60, 4))
    x[20:40] = x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    staged = []
    real = search.stage
    monkeypatch.setattr(search, "stage", lambda d, name="stage": staged.append(name) or real(d, name))
    got = similarity.semantic_join_classes(df.withColumnRenamed("vec_id", "qid"), df, 0.5).collect()
    assert "pairs" not in staged
    assert {(r.queries, r.vectors) for r in got if r.qid == 0 and r.vec_id == 0} == {(21, 21)}
    every = similarity.semantic_join_all(df.withColumnRenamed("vec_id", "qid"), df, 0.5)
    assert sum(r.queries * r.vectors for r in got) == every.count() == every.distinct().count()


def test_large_searches_move_less_by_wider_blocks(spark, monkeypatch):
    """Where blocks are many, each side has up to four times the rows: vectors travel fewer times, results stay."""
    rows, df = vectors(spark, 600, 8)
    queries, q = vectors(spark, 400, 8, seed=2)
    monkeypatch.setattr(tree, "BLOCKS_A_CORE", 0.1)
    built = Tree.build(index(df), cell_rows=20, branch=6, block_rows=50)
    sides = search.side(q, "vec_id", "embedding", "qid").withColumn("bound", F.lit(float(np.pi)))
    assert built.wide(1) == 50 and built.wide(400) == 200
    narrow, wide = (built.sides(built.visits(sides, side=n), sides, side=n) for n in (50, 200))
    assert sum(d.count() for d in wide[:2]) < 0.4 * sum(d.count() for d in narrow[:2])
    crowds = [d.groupBy(*wide[2]).count().agg(F.max("count")).first()[0] for d in wide[:2]]
    assert max(crowds) < 2 * 200
    assert found(search.nearest(q.toDF("qid", "embedding"), built, 4)) == best(queries, rows, 4)
    # Wide vectors keep narrow blocks.
    monkeypatch.setattr(tree, "BLOCK_BYTES", 4 * 8 * 60)
    assert built.wide(400) == 60


def test_unit_rows_are_made_without_a_second_copy():
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(7).normal(size=(20_000, 64)).astype(np.float32)
    x[5] = 0
    x[6] = np.nan
    column = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())
    tracemalloc.start()
    m = search.matrix(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wide = x.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    assert (m == np.divide(wide, norms, out=np.zeros_like(wide), where=norms > 0)).all() and peak < 1.5 * m.nbytes


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_rounds_over_the_index_equal_scoring_everything(spark, monkeypatch, threshold):
    rows, df = vectors(spark, 500, 6, crowd=150)
    rows += [(5000, [0.0] * 6), (5001, [0.0] * 6)]
    df = df.union(spark.createDataFrame(rows[-2:], df.schema)).union(spark.createDataFrame([(6000, None)], df.schema))
    queries, q = vectors(spark, 90, 6, seed=2, first=100)
    queries.append((7, [0.0] * 6))
    q = q.union(spark.createDataFrame([queries[-1], (8, None)], q.schema)).toDF("qid", "embedding")
    monkeypatch.setattr(search, "SLICE_ROWS", 10)
    wanted = [r for r in best(queries, rows, 4) if threshold is None or r[2] >= threshold]
    for index_ in (df, Tree.build(index(df), cell_rows=30, branch=5)):
        assert found(search.nearest(q, index_, 4, threshold, plan="rounds")) == wanted
    nothing = q.limit(0)
    assert search.nearest(nothing, df, 4, plan="rounds").count() == search.nearest(q, df.limit(0), 4, plan="rounds").count() == 0


def test_searches_that_cannot_be_pruned_move_neither_side(spark, monkeypatch):
    """Random directions: blocks of cells would move each side many times; what passes over the index write is a few rows a query."""
    rows, df = vectors(spark, 600, 16)
    queries, q = vectors(spark, 400, 16, seed=2)
    q = q.toDF("qid", "embedding")
    monkeypatch.setattr(search, "MAX_BROADCAST_ROWS", 50)
    monkeypatch.setattr(search, "MOVED_BYTES", 100_000)
    monkeypatch.setattr(search, "SLICE_ROWS", 100)
    monkeypatch.setattr(tree, "CELL_ROWS", 40)
    staged, blocks = [], []
    real, sides = search.stage, Tree.sides
    monkeypatch.setattr(search, "stage", lambda d, name="stage": staged.append(name) or real(d, name))
    monkeypatch.setattr(Tree, "sides", lambda *a, **b: blocks.append(1) or sides(*a, **b))
    assert found(search.nearest(q, df, 4, block_rows=20)) == best(queries, rows, 4)
    assert not blocks and set(staged) == {"index", "queries", "round"}
    # In two dimensions bounds leave out most cells, and the tree stays.
    (rows, df), (queries, q) = vectors(spark, 600, 2), vectors(spark, 400, 2, seed=2)
    assert found(search.nearest(q.toDF("qid", "embedding"), df, 4, block_rows=20)) == best(queries, rows, 4)
    assert blocks and staged.count("round") == 1


def test_sampled_share_of_cells_to_visit(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12)) * 30
    crowds = [(i, [float(c) for c in centres[i % 20] + rng.normal(size=12)]) for i in range(800)]
    apart = index(spark.createDataFrame(crowds, "vec_id bigint, embedding array<float>"))
    spread = index(vectors(spark, 800, 12)[1])
    shares = [search.share_met(x.select(x.vec_id.alias("qid"), "vec").limit(100), x, 20, 4, None) for x in (apart, spread)]
    assert shares[0] < 0.3 and shares[1] > 0.9
