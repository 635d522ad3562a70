"""Vector index and similarity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx, vectors as vx
from ..functions.entries import percent
from ..plans.components import connected, similar_edges
from ..plans.search import crowds, nearest, within, within_classes
from ..plans.tree import Tree
from ..schemas import LEVELS
from ..session import stage


def build_index(rows: DataFrame, dedup: bool = False) -> DataFrame:
    """Index rows from (vec_id, level, query, ts, embedding): unit vectors plus hash.

    ``dedup`` keeps the latest row per (level, query_hash); without it every
    write stays, as in an append-only index.
    """
    index = rows.select(
        "vec_id", "level", "query",
        tx.normalize_text(F.col("query")).alias("normalized_query"),
        tx.query_hash(F.col("query")).alias("query_hash"),
        "ts", vx.unit(F.col("embedding")).alias("embedding"),
    )
    if not dedup:
        return index
    # Winners are picked on narrow rows; vectors are not shuffled for it.
    latest = index.groupBy("level", "query_hash").agg(F.max(F.struct("ts", "vec_id")).alias("w"))
    return index.join(latest.select(F.col("w.vec_id").alias("vec_id")), "vec_id", "left_semi")


def remove_from_index(index: DataFrame, removals: DataFrame) -> DataFrame:
    return index.join(removals.select("query_hash", "level").distinct(), ["query_hash", "level"], "left_anti")


def clear_index(index: DataFrame, level: str | None = None) -> DataFrame:
    return index.limit(0) if level is None else index.filter(F.col("level") != level)


def _searched(index: DataFrame, level: str | None, placed: Tree | None) -> tuple[DataFrame, DataFrame | Tree]:
    """Index rows of a level, and what to search: they, or the saved cells of them."""
    rows = index if level is None else index.filter(F.col("level") == level)
    if placed is None:
        return rows, rows
    return rows, placed if level is None else placed.only(rows)


def similar_queries(
    queries, index, threshold, level: str | None = None, k: int = 10, placed: Tree | None = None, **search
) -> DataFrame:
    """(qid, vec_id, query_hash, sim, rank): up to k matches at or above the threshold.

    ``placed``: the index saved by :class:`~answerloom.plans.tree.Tree`; ``index`` then needs no vectors.
    """
    index, searched = _searched(index, level, placed)
    found = nearest(queries, searched, k, threshold, **search)
    return found.join(index.select("vec_id", "query", "query_hash"), "vec_id")


def best_match(queries, index, threshold, level: str | None = None, placed: Tree | None = None, **search) -> DataFrame:
    return nearest(queries, _searched(index, level, placed)[1], 1, threshold, **search).drop("rank")


def similarity_report(queries, index, threshold, level: str | None = None, **search) -> DataFrame:
    """One row per query: matches found (up to 10), the best, and the top five."""
    found = similar_queries(queries, index, threshold, level, **search)
    # At most ten rows per query.
    per_query = found.groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"),
        F.min_by("query_hash", "rank").alias("best_hash"),
        F.max("sim").alias("best_sim"),
        F.slice(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "sim"))), 1, 5).alias("matches"),
    )
    return (
        queries.select(
            "qid", "query", tx.normalize_text(F.col("query")).alias("normalized_query"),
            tx.query_hash(F.col("query")).alias("query_hash"),
        )
        .join(per_query, "qid", "left")
        .withColumn("similar_queries_found", F.coalesce("found", F.lit(0)).cast("bigint"))
        .withColumn("threshold_used", F.lit(float(threshold)))
        .drop("found")
    )


def similarity_stats(queries, index, threshold, **search) -> DataFrame:
    """Searches, hits, hit rate and the mean similarity of the last search with a hit."""
    found = nearest(queries, index, 10, threshold, **search)
    per_search = found.groupBy("qid").agg(F.avg("sim").alias("avg_sim"))
    return (
        queries.select("qid").join(per_search, "qid", "left")
        .agg(
            F.count(F.lit(1)).alias("similarity_searches"),
            F.count("avg_sim").alias("similarity_hits"),
            F.round(F.max_by("avg_sim", F.when(F.col("avg_sim").isNotNull(), F.col("qid"))), 3).alias("average_similarity"),
        )
        .withColumn("hit_rate", percent(F.col("similarity_hits"), F.col("similarity_searches"), 2))
    )


def index_counts(index: DataFrame) -> DataFrame:
    """Rows per level, zeros listed. The level list has four rows."""
    levels = index.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    counts = index.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def cosine_pairs(pairs: DataFrame, left: str, right: str, name: str = "sim") -> DataFrame:
    return pairs.withColumn(name, vx.cosine(F.col(left), F.col(right)))


def semantic_join(queries, index, threshold, k: int = 10, **search) -> DataFrame:
    """Pairs (qid, vec_id, sim) of a query and its up to k neighbours above the threshold."""
    return nearest(queries, index, k, threshold, **search)


def semantic_join_all(queries, index, threshold, **search) -> DataFrame:
    """Pairs (qid, vec_id, sim) of a query and every neighbour at or above the threshold."""
    return within(queries, index, threshold, **search)


def semantic_join_classes(queries, index, threshold, **search) -> DataFrame:
    """(qid, vec_id, sim, queries, vectors): one row per pair of classes of exact copies, by smallest ids, with their sizes.

    The rows of :func:`semantic_join_all` are these, each ``queries * vectors`` times.
    """
    pairs, asked, stored = within_classes(queries, index, threshold, **search)
    left = crowds(asked, "qid_rep").withColumnRenamed("size", "queries")
    right = crowds(stored, "vec_id_rep").withColumnRenamed("size", "vectors")
    one = F.lit(1).cast("bigint")
    return pairs.join(left, "qid_rep", "left").join(right, "vec_id_rep", "left").select(
        F.col("qid_rep").alias("qid"), F.col("vec_id_rep").alias("vec_id"), "sim",
        F.coalesce("queries", one).alias("queries"), F.coalesce("vectors", one).alias("vectors"))


def semantic_duplicates(vectors: DataFrame, threshold: float, id_col="vec_id", vec_col="embedding", **search) -> DataFrame:
    """(id, group_id) of every row with a near copy; group_id is the smallest id."""
    return connected(similar_edges(vectors, threshold, id_col=id_col, vec_col=vec_col, **search))


def semantic_clusters(
    vectors: DataFrame, threshold: float, accesses: DataFrame, live: DataFrame,
    id_col="vec_id", **search,
) -> DataFrame:
    """Groups of similar rows by accesses, with how many members are not cached.

    ``accesses``: (id, n); ``live``: (id).
    """
    groups = semantic_duplicates(vectors, threshold, id_col, **search)
    return (
        groups.join(accesses, "id", "left")
        .join(live.select("id").distinct().withColumn("cached", F.lit(1)), "id", "left")
        .groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("accesses"),
            F.count_if(F.col("cached").isNull()).alias("missing"),
        )
    )


def reuse_embeddings(
    texts: DataFrame, known: DataFrame, embed, text_col: str = "query", id_col: str = "id"
) -> DataFrame:
    """(id, query_hash, embedding, reused): known vectors by hash, each new text embedded once.

    ``embed`` maps a string column to an ``array<float>`` column. Texts are
    hashed once; grouping and joining then work on ids and hashes, and only the
    text chosen for each new hash (smallest id) is read again.
    """
    hashed = stage(texts.select(id_col, tx.query_hash(F.col(text_col)).alias("query_hash")), "hashes")
    known = known.select("query_hash", "embedding")
    chosen = hashed.groupBy("query_hash").agg(F.min(id_col).alias(id_col)).join(known, "query_hash", "left_anti")
    fresh = texts.select(id_col, text_col).join(chosen, id_col).select(
        "query_hash", embed(F.col(text_col)).alias("embedding")
    )
    table = known.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
    return hashed.join(table, "query_hash", "left")


def drift(history: DataFrame, limit: float = 0.1, keep: int = 10) -> DataFrame:
    """(query_hash, drift) where first and last of the last ``keep`` vectors differ."""
    # Equal times are told apart by the vectors, so reruns agree.
    w = Window.partitionBy("query_hash").orderBy(F.col("ts").desc(), F.col("embedding").desc())
    recent = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    ends = recent.groupBy("query_hash").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("embedding", F.struct("ts", "embedding")).alias("first"),
        F.max_by("embedding", F.struct("ts", "embedding")).alias("last"),
    )
    return (
        ends.filter("n >= 2")
        .withColumn("drift", F.round(1 - vx.raw_cosine(F.col("first"), F.col("last")), 6))
        .filter(F.col("drift") > limit)
        .select("query_hash", "n", "drift")
    )
