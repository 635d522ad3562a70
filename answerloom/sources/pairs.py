"""Labelled question pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import PAIRS


def read_pairs_csv(spark: SparkSession, path: str, schema=PAIRS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def first_rows(pairs: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` rows in file order, which takes an id: files have none in Spark."""
    return pairs.orderBy(order).limit(n)


def valid_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("is_duplicate").isin(0, 1))
