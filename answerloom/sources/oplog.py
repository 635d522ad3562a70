"""Operation logs as JSON lines, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changelog import project_log
from ..schemas import OP_LOG

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def append_log(ops: DataFrame, path: str) -> None:
    project_log(ops).write.mode("append").partitionBy("log_date").json(path, timestampFormat=TIME_FORMAT)


def read_log(spark: SparkSession, path: str, since=None, schema=OP_LOG) -> DataFrame:
    """Well-formed lines, strictly after ``since``; day folders before it are not read."""
    log = spark.read.schema(f"{_ddl(schema)}, log_date date").json(
        path, mode="DROPMALFORMED", timestampFormat=TIME_FORMAT
    )
    if since is not None:
        log = log.filter((F.col("log_date") >= F.to_date(F.lit(since))) & (F.col("ts") > F.lit(since)))
    return log.drop("log_date")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def stream_log(spark: SparkSession, path: str, schema=OP_LOG) -> DataFrame:
    return spark.readStream.schema(schema).json(path, mode="DROPMALFORMED", timestampFormat=TIME_FORMAT)
