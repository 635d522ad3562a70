"""Schemas of the tables this library reads and writes."""

from pyspark.sql import types as T

LEVELS = ("query", "embedding", "context", "result")  # also the lookup priority

PAIRS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("qid1", T.LongType()),
    T.StructField("qid2", T.LongType()),
    T.StructField("question1", T.StringType()),
    T.StructField("question2", T.StringType()),
    T.StructField("is_duplicate", T.IntegerType()),
])

OP_LOG = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("operation", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ttl", T.IntegerType()),
])

ACCESS_LOG = T.StructType([
    T.StructField("cache_id", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
])

ANSWER = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("context", T.ArrayType(T.StringType())),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
])

VECTOR = T.ArrayType(T.FloatType())

ALERTS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])

RULES = T.StructType([
    T.StructField("rule_type", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("action", T.StringType()),
    T.StructField("affected_levels", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
])
