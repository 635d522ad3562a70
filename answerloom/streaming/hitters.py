"""Most frequent keys of a stream: a summary of bounded size, and exact counts of what it names.

The summary (Misra and Gries) has at most ``counters`` keys. A batch's counts
are added to it; if more keys are left, the largest count that has to go is
taken off all, and what was taken off adds up to ``error``. A key has at least
its summary count and at most ``error`` more, and one that is not in the
summary has at most ``error``. Summaries of parts of a log merge the same way.

:func:`popular_items` counts the named keys exactly in one pass over the stored
log, which is not shuffled by key. If fewer than ``limit`` of them lie above
the error, a key that is not named could be as frequent, and all keys are
counted instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import warming
from ..session import stage

COUNTERS = 10_000
_ROWS = "key string, n bigint, error bigint"


def merged(parts: DataFrame, counters: int) -> DataFrame:
    """One summary (key, n, error) out of rows of several; a row without a count only carries its error."""
    errors = parts.filter("n is null").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("error")).first()["error"]
    sums = stage(parts.filter("n is not null").groupBy("key").agg(F.sum("n").alias("n")), "hitters")
    # At most ``counters`` + 1 rows.
    top = sums.orderBy(F.col("n").desc()).limit(counters + 1)
    seen = top.agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("least")).first()
    cut = seen["least"] if seen["keys"] > counters else 0
    kept = top.select("key", (F.col("n") - cut).alias("n"), F.lit(0).cast("bigint").alias("error")).filter("n > 0")
    total = parts.sparkSession.createDataFrame([(None, None, errors + cut)], _ROWS)
    return kept.unionByName(total)


def counts(log: DataFrame, key: str = "key") -> DataFrame:
    """A batch as rows to be merged."""
    return log.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
        "key", "n", F.lit(0).cast("bigint").alias("error"))


class Summary:
    """The summary of a stream under a path, one small folder per batch, of which the last two are kept.

    A batch that runs again starts from the one before it and replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str, counters: int = COUNTERS):
        if counters < 1:
            raise ValueError("counters must be positive")
        self.spark, self.path, self.counters = spark, path, counters

    def _folders(self) -> list[int]:
        """Complete batches, oldest first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        to_path = jvm.org.apache.hadoop.fs.Path
        fs = to_path(self.path).getFileSystem(conf)
        if not fs.exists(to_path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(to_path(self.path))]
        return sorted(
            int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(to_path(f"{self.path}/{n}/_SUCCESS")))

    def rows(self, before: int | None = None) -> DataFrame:
        done = [b for b in self._folders() if before is None or b < before]
        if not done:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/batch={done[-1]}")

    def add(self, batch: DataFrame, batch_id: int, key: str = "key") -> None:
        both = self.rows(batch_id).unionByName(counts(batch, key))
        merged(both, self.counters).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        to_path = jvm.org.apache.hadoop.fs.Path
        for old in [b for b in self._folders() if b < batch_id][:-1]:
            to_path(self.path).getFileSystem(conf).delete(to_path(f"{self.path}/batch={old}"), True)

    def error(self) -> int:
        return self.rows().filter("n is null").agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]

    def keys(self) -> DataFrame:
        """(key, n): at most ``counters`` rows."""
        return self.rows().filter("n is not null").select("key", "n")


def summarise(log: DataFrame, path: str, counters: int = COUNTERS, key: str = "key") -> Summary:
    """Runs a stream of accesses to its end, keeping its summary under ``path``."""
    summary = Summary(log.sparkSession, f"{path}/summary", counters)
    query = (
        log.writeStream.foreachBatch(lambda batch, batch_id: summary.add(batch, batch_id, key))
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return summary


def popular_items(log: DataFrame, summary: Summary, limit: int = 10) -> DataFrame:
    """:func:`~answerloom.operators.warming.popular_items` of a stored log, from the summary of its stream."""
    named = stage(warming.popular_items(log, limit, summary.keys().select("key")), "named-items")
    if named.filter(F.col("access_count") > summary.error()).count() < limit and summary.error() > 0:
        return warming.popular_items(log, limit)
    return named
