"""Expressions over stored entries: level, lifetime, size, pressure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas

# Seconds an entry lives, by level, and for any other level.
TTL_BY_LEVEL = {"query": 300, "embedding": 1800, "context": 900, "result": 3600}
TTL_DEFAULT = 3600


def classify_level(kind: Column, text_length: Column, has_answer: Column) -> Column:
    """Level for a value of ``kind`` string / array / object / other."""
    return (
        F.when((kind == "string") & (text_length < 1000), F.lit("query"))
        .when(kind == "array", F.lit("embedding"))
        .when((kind == "object") & has_answer, F.lit("result"))
        .otherwise(F.lit("context"))
    )


def level_of_value(value: Column) -> Column:
    """Level read off a stored text: JSON objects and arrays by their kind, anything else is a string."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    named = (
        F.when(parsed.isNull() | (kind == "STRING"), "string").when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object").otherwise("other")
    )
    return classify_level(named, F.length(value), F.get_json_object(value, "$.answer").isNotNull())


def ttl_for(level: Column, ttl: Column | None = None, scale: int = 1) -> Column:
    """Given lifetime (zero counts) or the default of the level."""
    table = F.create_map(*[F.lit(x) for k, v in TTL_BY_LEVEL.items() for x in (k, v * scale)])
    default = F.coalesce(F.try_element_at(table, level), F.lit(TTL_DEFAULT * scale))
    return default if ttl is None else F.coalesce(ttl.cast("int"), default)


def expires_at(ts: Column, ttl: Column) -> Column:
    return ts + F.make_dt_interval(secs=ttl)


def is_expired(expires: Column, now) -> Column:
    """Strictly past; an entry without a lifetime never expires, nor does any with ``now`` None."""
    return F.lit(False) if now is None else F.coalesce(F.lit(now) > expires, F.lit(False))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in schemas.LEVELS]), level)


def value_bytes(value: Column) -> Column:
    """UTF-8 bytes of a text value; nothing for null."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


def vector_bytes(vector: Column) -> Column:
    return F.coalesce(F.lit(4) * F.array_size(vector), F.lit(0)).cast("bigint")


def pressure(used: Column, limit: Column) -> Column:
    ratio = used / limit
    return (
        F.when((used == 0) | (ratio < 0.5), "low")
        .when(ratio < 0.8, "medium")
        .when(ratio < 0.95, "high")
        .otherwise("critical")
    )


def absolute_pressure(used: Column) -> Column:
    mib = 1024 * 1024
    return F.when(used > 100 * mib, "high").when(used > 50 * mib, "medium").otherwise("low")


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def parsed_value(value: Column, schema: str) -> Column:
    """A stored JSON value as columns of ``schema``; null where it is none."""
    return F.from_json(value, schema, {"mode": "PERMISSIVE"})


# Settings with the smallest and largest value each may have.
SETTING_LIMITS = (("threshold", 0.0, 1.0), ("ttl", 0.0, None), ("interval", 1.0, None))


def setting_problem(name: Column, value: Column) -> Column:
    """What is wrong with a setting; null where nothing is, or where the name is none of those known."""
    found = F.lit(None).cast("string")
    for setting, least, most in SETTING_LIMITS:
        low = F.when(value.isNull() | F.isnan(value), f"{setting} is missing").when(value < least, f"{setting} is below {least:g}")
        found = F.when(name == setting, low if most is None else low.when(value > most, f"{setting} is above {most:g}")).otherwise(found)
    return found
