"""Compressed vectors: recall, bytes, and what comes back."""

import numpy as np
import pytest
from answerloom.plans import quantised, search
from answerloom.plans.quantised import Quantised, nearest_quantised
from pyspark.sql import functions as F


def frame(spark, x, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], f"{name} bigint, embedding array<float>")


def index(df):
    return search.side(df, "vec_id", "embedding", "vec_id")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    # Nothing but random directions: the hardest case for any pruning.
    return frame(spark, rng.normal(size=(3_000, 32))), frame(spark, rng.normal(size=(60, 32)), name="qid")


def test_recall_and_bytes(spark, data, tmp_path):
    df, q = data
    Quantised.build(index(df), str(tmp_path / "codes"), rounds=3)
    placed = Quantised.read(spark, str(tmp_path / "codes"))
    found = nearest_quantised(q, placed, 10)
    rows = found.collect()
    assert len(rows) == 600 and max(r.read_share for r in rows) <= 0.25
    exact = search.nearest(q, df, 10)
    rates = search.recall(found, exact).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert rates[0] >= 0.9 and rates[1] == 60
    truth = {(r.qid, r.vec_id): r.sim for r in search.nearest(q, df, 3_000).collect()}
    assert all(abs(truth[r.qid, r.vec_id] - r.sim) <= 1.1e-6 for r in rows)


def test_fewer_cells_and_codes_read_less(spark, data):
    df, q = data
    placed = Quantised.build(index(df), cells=16, parts=8, rounds=1)
    some, all_ = (nearest_quantised(q, placed, 5, rerank=20, probes=p).agg(F.max("read_share")).first()[0] for p in (4, None))
    assert some < all_ <= 0.08


def test_codes_follow_the_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 7))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wide = np.pad(x, ((0, 0), (0, 1)))
    words = np.stack([wide[:256, 2 * p:2 * p + 2] for p in range(4)])
    book = quantised.Codebook(np.zeros((1, 8)), words)
    cell, code = book.encode(x)
    assert not cell.any() and (code[:256] == np.arange(256)[:, None]).mean() > 0.99
    base, table = book.tables(x[:3])
    scores = base[:, [0]] + sum(table[p][:, code[:, p]] for p in range(4))
    again = np.hstack([words[p][code[:, p]] for p in range(4)])
    assert np.allclose(scores, np.pad(x[:3], ((0, 0), (0, 1))) @ again.T)
    same = quantised.Codebook.of([dict(zip(("kind", "a", "b", "value"), r)) for r in book.rows()])
    assert (same.words == book.words).all() and (same.centroids == book.centroids).all()


def test_edge_indexes(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "qid bigint, embedding array<float>")
    assert nearest_quantised(q, Quantised.build(index(empty), rounds=1), 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0])], empty.schema)
    got = [(r.vec_id, r.sim) for r in nearest_quantised(q, Quantised.build(index(few), rounds=1), 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0), (4, 0.0)]
    with pytest.raises(ValueError):
        nearest_quantised(q, Quantised.build(index(few), rounds=1), 3, rerank=2)


def test_all_codes_are_met_without_visits_and_scores_are_those_of_the_tables(spark, data):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<float>")
    built = quantised.Quantised.build(df, cells=6, parts=5, codes=16)
    q = df.limit(20).withColumnRenamed("vec_id", "qid")
    got = {(r.qid, r.vec_id): r.sim for r in search.keep_best(built.scan(None, q, 400), 400).collect()}
    assert len(got) == 20 * 400
    coded = {r.vec_id: (r.cell, np.frombuffer(bytes(r.code), np.uint8)) for r in built.codes.collect()}
    for r in q.collect():
        v = np.array(r.vec, dtype=np.float64)[None]
        base, table = built.book.tables(v / np.linalg.norm(v))
        for i, (cell, code) in coded.items():
            assert abs(got[r.qid, i] - (base[0, cell] + table[np.arange(5), 0, code].sum())) < 2e-6
