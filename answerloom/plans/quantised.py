"""Approximate nearest vectors from compressed ones: residual product quantisation.

A vector is the sum of its cell's centroid and a residual. The residual is cut
into ``parts`` pieces, and each piece is replaced by the number of the nearest
of at most 256 codewords: a byte a piece instead of four a component. The score of
a stored vector is the product with the sum that its cell and its codes name;
sums are put together once for each block of codes, whatever number of queries
meets it there. The best few by that score are scored again on the vectors themselves,
so what comes back is exact but may lack some of the true best; the operator
says what share of the bytes each query's scores came from, and
:func:`~answerloom.plans.search.recall` says what it found.

Centroids and codewords come from rounds of assign-and-average, run as Spark
jobs over a bounded sample (``fit_rows``); every vector is then coded. Codes
and vectors are kept apart, by cell, so a scan of codes reads no vectors, and
the second step reads only cells with candidates in them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as vx
from ..session import broadcast_if_small, stage
from .search import BLOCK_ROWS, FOUND, FOUND_DDL, TILE_COLS, Best, found_table, keep_best, matrix, side, valid

CODES = 256
MAX_CENTROIDS = 1_024
FIT_ROWS = 100_000
ROUNDS = 8
CODED = "vec_id bigint, cell int, code binary"
STORED = "vec_id bigint, cell int, vec array<float>"


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, by squared distance."""
    return ((centres * centres).sum(axis=1)[None, :] - 2 * m @ centres.T).argmin(axis=1)


class Codebook:
    """Centroids (cells x dims) and codewords (parts x codes x piece), of unit vectors."""

    def __init__(self, centroids: np.ndarray, words: np.ndarray):
        self.centroids, self.words = centroids, words
        self.parts, self.codes, self.piece = words.shape

    def pad(self, m: np.ndarray) -> np.ndarray:
        """Columns of zeros up to a whole number of pieces."""
        return np.pad(m, ((0, 0), (0, self.parts * self.piece - m.shape[1])))

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, one byte per piece) of unit rows."""
        m = self.pad(m)
        cell = _nearest(m, self.centroids)
        left = m - self.centroids[cell]
        code = np.stack(
            [_nearest(left[:, p * self.piece:(p + 1) * self.piece], self.words[p]) for p in range(self.parts)], axis=1)
        return cell, code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with centroids (queries x cells) and with codewords (parts x queries x codes)."""
        q = self.pad(q)
        pieces = q.reshape(len(q), self.parts, self.piece)
        return q @ self.centroids.T, np.einsum("qps,pcs->pqc", pieces, self.words)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The sums that cells and codes stand for."""
        left = self.words[np.arange(self.parts)[None, :], code].reshape(len(code), -1)
        return self.centroids[cell] + left

    def rows(self) -> list[tuple]:
        out = [("cell", i, 0, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return out + [("word", p, i, [float(x) for x in w]) for p, words in enumerate(self.words) for i, w in enumerate(words)]

    @classmethod
    def of(cls, rows: list) -> Codebook:
        cells = [r["value"] for r in sorted((r for r in rows if r["kind"] == "cell"), key=lambda r: r["a"])]
        words = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: (r["a"], r["b"]))
        parts = 1 + max(r["a"] for r in words)
        return cls(np.array(cells), np.array([r["value"] for r in words]).reshape(parts, len(words) // parts, -1))


def _means(sample: DataFrame, assign, centres: np.ndarray) -> np.ndarray:
    """One round: centres as the means of what is nearest to them; a centre nothing is near stays.

    ``centres`` (groups x k x dims); ``assign(matrix, centres)`` gives per group
    the numbers of the nearest and the points averaged. A task returns sums per
    centre, which number a bounded sample's tasks times groups times k.
    """
    groups, k, dims = centres.shape
    shared = sample.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        total, n = np.zeros((groups, k, dims)), np.zeros((groups, k), dtype=np.int64)
        for batch in batches:
            for g, (near, points) in enumerate(assign(matrix(batch.column(0)), shared.value)):
                for d in range(dims):
                    total[g, :, d] += np.bincount(near, weights=points[:, d], minlength=k)
                n[g] += np.bincount(near, minlength=k)
        g, i = np.nonzero(n)
        if len(g):
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(i), pa.array(n[g, i]), pa.array(list(total[g, i]))], names=["g", "i", "n", "total"])

    found = sample.select("vec").mapInArrow(run, "g bigint, i bigint, n bigint, total array<double>").toArrow()
    total, n = np.zeros(centres.shape), np.zeros((groups, k))
    if found.num_rows:
        g, i = found.column("g").to_numpy(), found.column("i").to_numpy()
        np.add.at(n, (g, i), found.column("n").to_numpy())
        np.add.at(total, (g, i), np.array(found.column("total").to_pylist()))
    return np.where(n[..., None] > 0, total / np.maximum(1, n)[..., None], centres)


def fit(
    index: DataFrame, cells: int | None = None, parts: int | None = None, codes: int = CODES, rounds: int = ROUNDS,
    fit_rows: int = FIT_ROWS,
) -> Codebook:
    """Codebook of (vec_id, vec) rows, from about ``fit_rows`` of them picked by hash; default pieces have two components."""
    if not 1 <= codes <= CODES:
        raise ValueError(f"codes must lie between 1 and {CODES}")
    rows = index.filter("vec is not null")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    n, dims = known["n"], known["dims"] or 1
    parts = parts or math.ceil(dims / 2)
    piece = math.ceil(dims / parts)
    share = min(1.0, fit_rows / max(1, n))
    sample = stage(rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("vec_id", "vec"), "fit-sample")
    cells = cells or max(1, min(MAX_CENTROIDS, math.ceil(math.sqrt(n) / 4)))

    def starts(count: int, seed: int) -> np.ndarray:
        drawn = sample.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(count).select("vec").toArrow().column(0)
        m = matrix(drawn)
        m = m if len(m) else np.zeros((1, dims))
        return np.pad(m, ((0, 0), (0, parts * piece - m.shape[1])))

    def wide(m):
        return np.pad(m, ((0, 0), (0, parts * piece - m.shape[1])))

    centroids = starts(cells, 0)[None]
    for _ in range(rounds):
        centroids = _means(sample, lambda m, c: [(_nearest(wide(m), c[0]), wide(m))], centroids)
    centroids = centroids[0]

    def left(m):
        m = wide(m)
        return m - centroids[_nearest(m, centroids)]

    first = left(starts(codes, 1))
    words = np.stack([first[:, p * piece:(p + 1) * piece] for p in range(parts)])

    def by_part(m, w):
        rest = left(m)
        pieces = [rest[:, p * piece:(p + 1) * piece] for p in range(parts)]
        return [(_nearest(x, w[p]), x) for p, x in enumerate(pieces)]

    for _ in range(rounds):
        words = _means(sample, by_part, words)
    return Codebook(centroids, words)


class Quantised:
    """An index of codes beside its vectors, both by cell."""

    def __init__(self, book: Codebook, codes: DataFrame, vectors: DataFrame):
        self.spark, self.book, self.codes, self.vectors = codes.sparkSession, book, codes, vectors
        # At most MAX_CENTROIDS rows.
        self.size = {r["cell"]: r["n"] for r in codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    @classmethod
    def build(cls, index: DataFrame, path: str | None = None, book: Codebook | None = None, **fitting) -> Quantised:
        """Codes all (vec_id, vec) rows. ``path`` keeps index and codebook for later."""
        rows = stage(index.select("vec_id", "vec"), "quantised-rows").filter("vec is not null")
        book = book or fit(rows, **fitting)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    cell, code = book.encode(matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)],
                        names=["vec_id", "cell", "code", "vec"])

        both = stage(rows.mapInArrow(run, CODED + ", vec array<float>"), "quantised")
        if path is None:
            return cls(book, both.select("vec_id", "cell", "code"), both.select("vec_id", "cell", "vec"))
        spark = rows.sparkSession
        both.select("vec_id", "code", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
        both.select("vec_id", "vec", "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame(book.rows(), "kind string, a int, b int, value array<double>").coalesce(1).write.parquet(f"{path}/book")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Quantised:
        # Bounded by the codebook: MAX_CENTROIDS centroids and CODES words a piece.
        book = Codebook.of(spark.read.parquet(f"{path}/book").collect())
        return cls(book, spark.read.schema(CODED).parquet(f"{path}/codes"), spark.read.schema(STORED).parquet(f"{path}/vectors"))

    def visits(self, q: DataFrame, probes: int) -> DataFrame:
        """(qid, cell): the ``probes`` cells whose centroids score best."""
        ids = np.array(sorted(self.size), dtype=np.int32)
        book = self.book

        def go(batches):
            for batch in batches:
                batch = valid(batch)
                if not batch.num_rows:
                    continue
                scores = (book.pad(matrix(batch.column(1))) @ book.centroids.T)[:, ids]
                keep = min(probes, len(ids))
                best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(best)), keep))), pa.array(ids[best].ravel())], names=["qid", "cell"])

        return stage(q.select("qid", "vec").mapInArrow(go, "qid bigint, cell int"), "visits")

    def scan(self, visits: DataFrame | None, q: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, sim): the k best of every block of codes, by their coded scores; without ``visits`` of all codes, whatever their cell."""
        if visits is None:
            # Every query meets every code, so blocks need not be those of cells.
            visits, codes = q.select("qid", F.lit(-1).alias("block")), self.codes.withColumn("block", F.lit(-1))
            crowd, size = {-1: q.count()}, {-1: sum(self.size.values())}
        else:
            visits, codes, size = visits.withColumnRenamed("cell", "block"), self.codes.withColumn("block", F.col("cell")), self.size
            # At most MAX_CENTROIDS rows.
            crowd = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(c, math.ceil(n / BLOCK_ROWS), math.ceil(crowd[c] / BLOCK_ROWS)) for c, n in size.items() if crowd.get(c)]
        parts = F.broadcast(self.spark.createDataFrame(plan, "block int, parts int, qparts int"))
        left = (
            visits.join(parts, "block").join(q.select(F.col("qid").alias("qid"), F.col("vec").alias("vec")), "qid")
            .withColumn("qpart", F.expr("pmod(xxhash64(qid), qparts)").cast("int"))
            .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("block", "part", "qpart", "qid", "vec"))
        right = (
            codes.join(parts, "block").withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)").cast("int"))
            .withColumn("qpart", F.explode(F.expr("sequence(0, qparts - 1)"))).select("block", "part", "qpart", "vec_id", "cell", "code"))
        keys = ["block", "part", "qpart"]
        book = self.book

        def score(one: pa.Table, other: pa.Table) -> pa.Table:
            if one.num_rows == 0 or other.num_rows == 0:
                return FOUND.empty_table()
            ids, cell = other.column("vec_id").to_numpy(), other.column("cell").to_numpy()
            code = np.frombuffer(b"".join(other.column("code").to_pylist()), np.uint8).reshape(-1, book.parts)
            longest = np.sqrt((book.centroids ** 2).sum(axis=1).max()) + np.sqrt((book.words ** 2).sum(axis=2).max(axis=1).sum())
            best = Best(one.column("qid").to_numpy(), book.pad(matrix(one.column("vec"))), k, longest=longest)
            for a in range(0, len(ids), TILE_COLS):
                best.add(ids[a:a + TILE_COLS], book.decode(cell[a:a + TILE_COLS], code[a:a + TILE_COLS]))
            return found_table(best.found())

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, FOUND_DDL)


def nearest_quantised(
    queries: DataFrame, placed: Quantised, k: int = 10, rerank: int | None = None, probes: int | None = None, *,
    query_id: str = "qid", query_vec: str = "embedding",
) -> DataFrame:
    """(qid, vec_id, sim, rank, read_share): about the k best, of ``rerank`` candidates by coded score.

    ``rerank`` is four times k unless given, ``probes`` all cells. ``sim`` is
    exact. ``read_share``: bytes of the codes and vectors this query was scored
    on, as a share of the bytes of all vectors. Never chosen by
    :func:`~answerloom.plans.search.nearest`.
    """
    rerank = 4 * k if rerank is None else rerank
    if k < 1 or rerank < k or (probes is not None and probes < 1):
        raise ValueError("k and probes must be positive, and rerank no smaller than k")
    spark = queries.sparkSession
    q = stage(side(queries, query_id, query_vec, "qid"), "queries").filter("vec is not null")
    if not placed.size:
        return keep_best(spark.createDataFrame([], FOUND_DDL), k).withColumn("read_share", F.lit(0.0))
    visits = None if probes is None else placed.visits(q, probes)
    found = stage(keep_best(placed.scan(visits, q, rerank), rerank).select("qid", "vec_id"), "candidates")
    # Rows of the cells visited, each one code; and the candidates' vectors.
    if visits is None:
        coded = q.select("qid", F.lit(sum(placed.size.values())).alias("coded")).dropDuplicates(["qid"])
    else:
        sizes = F.broadcast(spark.createDataFrame(list(placed.size.items()), "cell int, n bigint"))
        coded = visits.join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("coded"))
    again = found.groupBy("qid").agg(F.count(F.lit(1)).alias("again"))
    bytes_each = 4 * placed.vectors.select(F.size("vec").alias("d")).filter("d > 0").limit(1).first()["d"]
    share = (F.col("coded") * placed.book.parts + F.col("again") * bytes_each) / F.lit(float(sum(placed.size.values()) * bytes_each))
    read = coded.join(again, "qid").select("qid", F.round(share, 4).alias("read_share"))
    wanted = broadcast_if_small(found)
    vectors = placed.vectors.select("vec_id", vx.unit(F.col("vec").cast("array<double>")).alias("_x"))
    scored = vectors.join(wanted, "vec_id").join(q.select("qid", vx.unit(F.col("vec").cast("array<double>")).alias("_q")), "qid")
    exact = scored.select("qid", "vec_id", F.round(vx.dot(F.col("_q"), F.col("_x")), 6).alias("sim"))
    return keep_best(exact, k).join(read, "qid")
