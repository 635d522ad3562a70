"""Looking answers up: exact, by level priority, semantic, and both in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.entries import is_expired, level_of_value, level_rank, ttl_for, expires_at
from ..plans.ordering import SLICE, rank_in_group, row_slices
from ..plans.search import nearest
from ..plans.tree import Tree
from ..schemas import LEVELS
from ..session import stage
from .similarity import build_index


WINDOW_ROWS = 100_000


def live(entries: DataFrame, now) -> DataFrame:
    return entries.filter(~is_expired(F.col("expires_at"), now) & F.col("value").isNotNull())


def exact_lookup(requests: DataFrame, entries: DataFrame, now) -> DataFrame:
    """Requests plus ``value`` and ``hit`` for (key, level)."""
    found = live(entries, now).select("key", "level", "value")
    return requests.join(found, ["key", "level"], "left").withColumn("hit", F.col("value").isNotNull())


def first_level(entries: DataFrame) -> DataFrame:
    """The entry of each key in the first level that holds it (live or not)."""
    by_rank = level_rank(F.col("level"))
    picked = F.min_by(F.struct("level", "value", "expires_at"), by_rank)
    return entries.groupBy("key").agg(picked.alias("e")).select("key", "e.*")


def exact_lookup_auto(requests: DataFrame, entries: DataFrame, now) -> DataFrame:
    """As :func:`exact_lookup` without a level: an expired first level is a miss."""
    found = live(first_level(entries), now).select("key", F.col("level").alias("found_level"), "value")
    return requests.join(found, "key", "left").withColumn("hit", F.col("value").isNotNull())


def existing(requests: DataFrame, entries: DataFrame, now, auto: bool = False) -> DataFrame:
    held = first_level(entries) if auto else entries
    alive = held.filter(~is_expired(F.col("expires_at"), now))
    return requests.join(alive, ["key"] if auto else ["key", "level"], "left_semi")


def missing(requests: DataFrame, entries: DataFrame, now, auto: bool = False) -> DataFrame:
    held = first_level(entries) if auto else entries
    alive = held.filter(~is_expired(F.col("expires_at"), now))
    return requests.join(alive, ["key"] if auto else ["key", "level"], "left_anti")


def value_level(level: str) -> str:
    """Matches at level query or result are answered from level result."""
    return "result" if level in ("query", "result") else level


def semantic_match(
    requests: DataFrame, entries: DataFrame, index: DataFrame, now, threshold: float,
    level: str = "result", scope: str = "live", placed: Tree | None = None, whole: bool = False, **search,
) -> DataFrame:
    """(qid, matched_query, sim, value) for requests whose best match has a live value.

    ``scope='all'`` takes the best match of the whole index and then asks
    whether its entry lives; ``'live'`` searches live rows only. ``placed`` is
    the index saved by :class:`~answerloom.plans.tree.Tree`; ``index`` then only says which of its
    vectors have which level and query, and needs no vectors. ``whole`` says
    that it holds no others than those to be searched.
    """
    if scope not in ("all", "live"):
        raise ValueError(f"unknown scope {scope!r}")
    values = (
        live(entries, now).filter(F.col("level") == value_level(level))
        .select(F.col("key").alias("matched_query"), "value")
    )
    rows = index.filter(F.col("level") == level).withColumnRenamed("query", "matched_query")
    rows = rows.select("vec_id", "matched_query", *(["embedding"] if placed is None else []))
    if scope == "live":
        rows = rows.join(values.select("matched_query"), "matched_query", "left_semi")
    searched = rows if placed is None else placed if whole else placed.only(rows)
    best = nearest(requests, searched, 1, threshold, **search).select("qid", "vec_id", "sim")
    return (
        best.join(rows.select("vec_id", "matched_query"), "vec_id")
        .join(values, "matched_query")
        .select("qid", "matched_query", "sim", "value")
    )


def cached_answer(
    requests: DataFrame, entries: DataFrame, index: DataFrame, now, threshold: float,
    level: str = "result", scope: str = "live", placed: Tree | None = None, **search,
) -> DataFrame:
    """(qid, query, source, matched_query, sim, value): exact, else semantic, else miss.

    Only exact misses are scored, and each missed question once however often
    it was asked: by the vector of the smallest qid that has one. Questions
    without a text are scored one by one. ``placed``: see :func:`semantic_match`.
    """
    values = live(entries, now).filter(F.col("level") == value_level(level)).select(F.col("key").alias("query"), "value")
    has = F.col("embedding").isNotNull().alias("_has")
    looked = stage(requests.select("qid", "query", has).join(values, "query", "left"), "looked")
    exact = looked.filter("value is not null").select(
        "qid", "query", F.lit("exact").alias("source"), F.col("query").alias("matched_query"),
        F.lit(1.0).alias("sim"), "value",
    )
    missed = looked.filter("value is null").drop("value")
    asked = stage(missed.filter("query is not null and _has").groupBy("query").agg(F.min("qid").alias("_asked")), "asked")
    rest = missed.join(asked, "query", "left").withColumn(
        "_asked", F.coalesce("_asked", F.when(F.col("query").isNull() & F.col("_has"), F.col("qid"))))
    alone = missed.filter("query is null and _has").select("qid")
    once = requests.select("qid", "embedding").join(asked.select(F.col("_asked").alias("qid")).unionByName(alone), "qid", "left_semi")
    found = semantic_match(once, entries, index, now, threshold, level, scope, placed, **search)
    rest = rest.join(found.withColumnRenamed("qid", "_asked"), "_asked", "left").select(
        "qid", "query",
        F.when(F.col("value").isNull(), "miss").otherwise("semantic").alias("source"),
        "matched_query", "sim", "value",
    )
    return exact.unionByName(rest)


def write_back(answers: DataFrame, entries: DataFrame, ttl_scale: int = 1) -> DataFrame:
    """Entries after storing ``answers`` (key, level, value, ttl, ts): latest per (key, level)."""
    written = answers.select(
        "key", "level", "value", F.col("ts").alias("created_at"),
        ttl_for(F.col("level"), F.col("ttl"), ttl_scale).alias("ttl_s"),
    ).withColumn("expires_at", expires_at(F.col("created_at"), F.col("ttl_s")))
    known = stage(written.filter(F.col("level").isin(*LEVELS)), "written")
    # Only keys that are written are aggregated; the rest of the store passes through.
    touched = known.select("key", "level").distinct()
    store = entries.select(known.columns)
    both = (
        store.join(touched, ["key", "level"], "left_semi").withColumn("_new", F.lit(0))
        .unionByName(known.withColumn("_new", F.lit(1)))
    )
    newest = F.max_by(F.struct("value", "created_at", "ttl_s", "expires_at"), F.struct("created_at", "_new", "value"))
    merged = both.groupBy("key", "level").agg(newest.alias("e")).select("key", "level", "e.*")
    return store.join(touched, ["key", "level"], "left_anti").unionByName(merged)


def latest_entries(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` entries created last (then by key and level); a large n goes by sliced ranks, which gather it in no task."""
    if n <= WINDOW_ROWS:
        return entries.orderBy(F.col("created_at").desc(), "key", "level").limit(n)
    order = ["_age", "key", "level"]
    aged = entries.withColumns({"_all": F.lit(0), "_age": -F.unix_micros("created_at")})
    laid = row_slices(aged, ["_all"], order)
    ranked = rank_in_group(laid, ["_all"], [F.col(c) for c in order], [F.col(SLICE)], name="_place")
    return ranked.filter(F.col("_place") <= n).select(entries.columns)


def store_answers(
    answers: DataFrame, entries: DataFrame, embed, capacity: int | None = None, ttl_scale: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Everything a write does, in one job: (entries after it, index rows to append).

    ``answers``: (key, value, level, ttl, ts). A null level is read off the
    value. At level result the key is embedded, at levels query and embedding
    the value; ``embed`` maps a text column to a vector column. ``capacity``
    keeps the latest ``capacity - 1`` entries. Index rows have their id from
    (key, level, ts), so a job that runs again gives the same ones.
    """
    if capacity is not None and capacity < 2:
        raise ValueError("capacity must be at least 2")
    placed = stage(answers.select(
        "key", "value", F.coalesce("level", level_of_value(F.col("value"))).alias("level"), "ttl", "ts"), "answers")
    after = write_back(placed, entries, ttl_scale)
    if capacity is not None:
        after = latest_entries(after, capacity - 1)
    text = F.when(F.col("level") == "result", F.col("key")).when(F.col("level").isin("query", "embedding"), F.col("value"))
    rows = placed.withColumn("query", text).filter("query is not null").select(
        F.xxhash64("key", "level", "ts").alias("vec_id"), "level", "query", "ts", embed(F.col("query")).alias("embedding"))
    return after, build_index(rows)
