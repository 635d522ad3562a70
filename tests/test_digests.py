"""Digest trees: what differs is found, what is equal is not gone into."""

import pytest
from answerloom.plans import digests
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_changes_are_listed(spark, levels):
    before = [(i, f"text {i}") for i in range(300)] + [(None, "no id"), (7, "twice"), (900, None), (901, ""), (902, "x")]
    after = [(i, f"text {i}") for i in range(300) if i % 50] + [(None, "no id"), (7, "twice"), (900, ""), (901, ""), (902, "x"), (902, "x"), (1000, "new")]
    after[3] = (after[3][0], "other")
    a, b = (spark.createDataFrame(x, DOCS).repartition(n) for x, n in ((before, 3), (after, 5)))
    got = {(r.doc_id, r.change) for r in digests.changed_documents(a, b, levels=levels).collect()}
    want = {(i, "removed") for i in range(0, 300, 50)} | {(after[3][0], "changed"), (900, "changed"), (902, "changed"), (1000, "added")}
    assert got == want
    assert digests.changed_documents(a, a.repartition(2), levels=levels).count() == 0


def test_only_unequal_branches_are_opened(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    other = docs.withColumn("text", F.when(F.col("doc_id") == 5, "new").otherwise(F.col("text")))
    one, two = digests.digest_tree(docs, 2), digests.digest_tree(other, 2)
    assert digests.unequal_leaves(one, two, 2).count() == 1
    assert one.filter("level = 0").first()["n"] == 3_000 and one.filter("level = 1").count() == 16
    assert digests.levels_for(10**9) == 5 and digests.levels_for(1) == 0
    got = digests.changed_documents(docs, other, levels=2, trees=(one, two)).collect()
    assert [(r.doc_id, r.change) for r in got] == [(5, "changed")]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], DOCS)
    assert digests.changed_documents(none, none).count() == 0
    assert [tuple(r) for r in digests.changed_documents(none, some).collect()] == [(1, "added")]
    assert [tuple(r) for r in digests.changed_documents(some, none).collect()] == [(1, "removed")]
