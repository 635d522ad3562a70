"""Text: normalising, hashing, sizes."""

from pyspark.sql import functions as F

from ..functions import text as tx
from . import query
from .views import NORMAL, documents, table

_N = NORMAL.format("text")


@query("normalize_text", f"SELECT doc_id, {_N} AS normalized FROM documents")
def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query("query_hash", f"SELECT conv_id, turn, md5({_N}) AS query_hash FROM conversations")
def query_hash(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.query_hash(F.col("text")).alias("query_hash"))


@query("parse_size", """
WITH s AS (SELECT doc_id, round(n_chars / 7.0::DOUBLE, 1) AS v, doc_id % 9 AS u FROM documents)
SELECT doc_id, trunc(v * CASE u WHEN 0 THEN 1024.0::DOUBLE ** 4 WHEN 1 THEN 1024.0::DOUBLE ** 3
  WHEN 2 THEN 1024.0::DOUBLE ** 2 WHEN 3 THEN 1024.0::DOUBLE WHEN 4 THEN 1 WHEN 5 THEN 1024.0::DOUBLE ** 2
  WHEN 6 THEN 1024.0::DOUBLE WHEN 7 THEN 1 END)::BIGINT AS bytes FROM s""")
def parse_size(spark, sf):
    units = F.array(*[F.lit(u) for u in ("TB", "gb", " MB ", "KB", "B", "M", "k", "", "XB")])
    text = F.concat(F.round(F.col("n_chars") / 7.0, 1).cast("string"), F.element_at(units, (F.col("doc_id") % 9 + 1).cast("int")))
    return documents(spark, sf).select("doc_id", tx.parse_size(text).alias("bytes"))
