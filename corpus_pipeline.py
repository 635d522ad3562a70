"""From raw documents to sharded training data, one operator per stage.

Each stage takes what the one before kept, and all but the last return the
columns of ``documents``. :func:`run` writes every stage to the shared folder
and reads it back, so a lost executor costs part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.llm import decontaminate, forest, langid, mixing, sharding
from answerloom.llm.common import read, settle, without
from answerloom.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not told: no letters, or a narrow margin."""
    settle(spark)
    learned = langid.train(docs.filter(~langid.held_out()))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return langid.classify(whole, learned, carry=["_row"]).filter("not rejected").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Where doc_ids repeat or are missing, every row is a document of its own:
    rows get numbers, and of a group that with the smallest doc_id (a missing
    one comes last), then text hash, stays.
    """
    settle(spark)
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return without(docs, stage(forest.near_duplicates(docs).filter("not kept").select("doc_id"), "near-copies"))
    # Written once, so that numbers stay what they are if a task is lost.
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("_number"), F.struct(*docs.columns).alias("_row")), "numbered")
    text = F.col("_row").getField("text")
    groups = forest.near_duplicates(numbered.select(F.col("_number").alias("doc_id"), text.alias("text")))
    known = F.col("_row").getField("doc_id")
    order = F.struct(known.isNull(), known, F.xxhash64(text), "_number").alias("_order")
    first = groups.select(F.col("doc_id").alias("_number"), "component_id").join(numbered.select("_number", order), "_number")
    first = first.groupBy("component_id").agg(F.min("_order").alias("_first")).select(F.col("_first._number").alias("_number"))
    return numbered.join(stage(first, "first-copies"), "_number", "left_semi").select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; every text is judged by itself."""
    key = ["doc_id", "_text"]
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    found = decontaminate.hits(held.drop("_row"), read(spark, sf_dir, "benchmark"), doc_key=key)
    hit = stage(found.filter("contaminated").select(*key), "contaminated")
    return without(held, hit, on=key).select("_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole."""
    settle(spark)
    return mixing.copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot along the Hilbert curve.

    A column of documents that is called shard or slot itself goes on as
    doc_shard or doc_slot (with more underscores if that is taken, too).
    """
    settle(spark)
    whole = docs.select("doc_id", "text", *[c for c in sharding.DIMENSIONS], F.struct(*docs.columns).alias("_row"))
    names = {}
    for own in docs.columns:
        name = f"doc_{own}" if own in ("shard", "slot") else own
        while name != own and name in docs.columns:
            name += "_"
        names[own] = name
    placed = sharding.hilbert_shards(whole, carry=["_row"])
    return placed.select(*[F.col("_row").getField(own).alias(name) for own, name in names.items()], "shard", "slot")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

# Language, near-duplicate search and curve order cannot be said in SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
