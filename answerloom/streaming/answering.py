"""Online answering: what one micro-batch had to ask for, the next one finds.

Entries are kept by :class:`~answerloom.streaming.jobs.StateStore`, question
vectors by a saved :class:`~answerloom.plans.tree.Tree`, and which vector stands
for which question in a folder per batch. A micro-batch is answered from what
the ones before it left; its misses are answered once per question, stored, and
indexed. All three are read as of the batch and written under its number, so a
batch that runs again does and finds the same; the index is compacted, if so
much has changed, before a batch and never inside it. Requests of one batch
don't see each other's answers: batches bound how soon an answer is found.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators.changelog import STATE
from ..operators.lookup import cached_answer, live, value_level
from ..plans.search import side
from ..plans.tree import Tree
from ..session import stage
from .jobs import StateStore
from .run import run_batches

OUTCOME = "qid bigint, query string, source string, matched_query string, sim double, value string"
_NAMES = "vec_id bigint, level string, query string, batch bigint"


class Answers:
    """Entries, index and names under a path, started once from tables."""

    def __init__(self, entries: DataFrame, index: DataFrame, path: str, now: datetime, level: str = "result"):
        """``entries``: key, level, value, created_at, expires_at. ``index``: vec_id, level, query, embedding.

        What is expired at ``now`` is not taken in.
        """
        self.spark, self.path, self.now, self.level = entries.sparkSession, path, now, level
        start = live(entries, now).filter(F.col("level") == value_level(level)).select(
            "key", "level", "value", "created_at", F.lit(-1).cast("bigint").alias("seq"), "expires_at", F.col("level").alias("ttl_level"))
        if not self._there("started"):
            kept = stage(start.select(*STATE), "answers")
            kept.write.mode("overwrite").parquet(f"{path}/start")
            rows = index.filter(F.col("level") == level).join(kept.select(F.col("key").alias("query")).distinct(), "query", "left_semi")
            rows.select("vec_id", "level", "query").write.mode("overwrite").parquet(f"{path}/names/batch=-1")
            Tree.build(side(rows, "vec_id", "embedding", "vec_id"), f"{path}/index")
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}/started")
        self.store = StateStore(self.spark.read.parquet(f"{path}/start"), f"{path}/entries")

    def _there(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return folder.getFileSystem(conf).exists(folder)

    def names(self, before: int) -> DataFrame:
        return self.spark.read.schema(_NAMES).parquet(f"{self.path}/names").filter(F.col("batch") < before).drop("batch")

    def answer(self, batch: DataFrame, batch_id: int, fetch: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
        """Outcome rows of a batch (qid, query, embedding); its misses go through ``fetch`` and are stored.

        ``fetch`` maps (qid, query) rows, one per question, to (query, value, ttl).
        """
        batch = stage(batch.select("qid", "query", "embedding"), "asked")
        tree = Tree.read(self.spark, f"{self.path}/index").compacted()
        entries, names = self.store.state(before=batch_id), self.names(batch_id)
        # The index has no other rows than those of the level, so none has to be picked out.
        found = stage(cached_answer(batch, entries, names, self.now, threshold, self.level, "all", placed=tree, whole=True), "answered")
        missed = found.filter("source = 'miss' and query is not null").groupBy("query").agg(F.min("qid").alias("qid"))
        missed = stage(missed, "missed")
        fresh = stage(fetch(missed.select("qid", "query")).select("query", "value", F.col("ttl").cast("int").alias("ttl")).filter("value is not null"), "fetched")
        ops = fresh.join(missed, "query").select(
            F.lit(self.now).cast("timestamp").alias("ts"), F.col("qid").alias("seq"), F.lit("set").alias("operation"),
            F.col("query").alias("key"), F.lit(value_level(self.level)).alias("level"), "value", "ttl")
        self.store.add(ops, batch_id, None)
        asked = batch.join(missed.withColumnRenamed("query", "_query"), "qid").filter("embedding is not null")
        rows = asked.join(fresh.select("query"), "query", "left_semi").select(
            F.xxhash64("query", F.lit(self.level)).alias("vec_id"), F.lit(self.level).alias("level"), "query", "embedding")
        rows = stage(rows.dropDuplicates(["vec_id"]), "indexed")
        rows.select("vec_id", "level", "query").write.mode("overwrite").parquet(f"{self.path}/names/batch={batch_id}")
        tree.append(side(rows, "vec_id", "embedding", "vec_id"), seq=batch_id + 1)
        return found


def answering_stream(
    requests: DataFrame, entries: DataFrame, index: DataFrame, path: str, now: datetime,
    fetch: Callable[[DataFrame], DataFrame], threshold: float, level: str = "result",
) -> DataFrame:
    """(qid, query, source, matched_query, sim, value, batch_id) for a stream of (qid, query, embedding)."""
    held = Answers(entries, index, path, now, level)
    return run_batches(requests, "answering", lambda batch, n: held.answer(batch, n, fetch, threshold), OUTCOME)
