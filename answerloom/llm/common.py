"""What the corpus operators share: settings, byte-exact lower-casing, words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import prepare

# Bounds what one Arrow batch puts into a Python worker, however long the texts are.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def settle(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. Plain ``lower`` is the fast way where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null text has none."""
    parts = F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(names: Sequence[str]) -> list[Column]:
    """Carried columns as one struct, so that no name of theirs meets one of an operator's own."""
    return [F.struct(*names).alias("_carry")] if names else []


def packed(names: Sequence[str]) -> list[str]:
    return ["_carry"] if names else []


def unpack(names: Sequence[str]) -> list[Column]:
    return [F.col("_carry").getField(n).alias(n) for n in names]


def fields(df: DataFrame, names: Sequence[str], more: str) -> StructType:
    """Schema of some columns of ``df``, all nullable, and of those that ``more`` declares."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = StructType()
    for name in names:
        out.add(name, kinds[name])
    for field in StructType.fromDDL(more):
        out.add(field)
    return out


def without(docs: DataFrame, dropped: DataFrame, on: Sequence[str] = ("doc_id",), most: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows whose key is in ``dropped``, null alike null: broadcast while those are few, else shuffled."""
    gone = dropped.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in on]
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, same, "left_anti")
