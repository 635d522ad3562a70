"""State snapshots: parquet folders named by time, vectors included."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

NAME_FORMAT = "%Y%m%d_%H%M%S"


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the snapshots there, oldest first: a folder listing, no data is read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [
        n for n in names
        if n.startswith("snapshot_ts=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    ]
    return sorted(n.split("=", 1)[1] for n in done)


def write_snapshot(state: DataFrame, path: str, at: datetime, min_interval_s: int = 0, force: bool = False) -> bool:
    """Writes ``snapshot_ts=...``; skipped (False) when the last one is too young.

    Names have whole seconds: a snapshot of the same second is replaced, so a
    batch that runs again does no harm.
    """
    if min_interval_s < 0:
        raise ValueError("min_interval_s must not be negative")
    names = _names(state.sparkSession, path)
    if names and not force:
        if at - datetime.strptime(names[-1], NAME_FORMAT) < timedelta(seconds=min_interval_s):
            return False
    state.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/snapshot_ts={at.strftime(NAME_FORMAT)}")
    return True


def read_snapshot(spark: SparkSession, path: str, schema, name: str | None = None) -> DataFrame:
    """The named or the latest complete snapshot; empty if there is none."""
    names = _names(spark, path)
    wanted = name if name is not None else (names[-1] if names else None)
    if wanted is None or wanted not in names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/snapshot_ts={wanted}")


def snapshot_info(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_ts, files, size_mb, modified), newest first; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    )
    try:
        listed = files.load(path).select("path", "length", "modificationTime")
    except AnalysisException:
        return spark.createDataFrame([], "snapshot_ts string, files bigint, size_mb double, modified timestamp")
    name = F.regexp_extract("path", r"snapshot_ts=([0-9_]+)", 1)
    return (
        listed.groupBy(name.alias("snapshot_ts"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.round(F.sum("length") / (1024 * 1024), 2).alias("size_mb"),
            F.max("modificationTime").alias("modified"),
        )
        .orderBy(F.col("snapshot_ts").desc())
    )
