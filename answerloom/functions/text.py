"""Text expressions: normalising, hashing, sizes, page text, fixed chunks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word characters and blanks as Unicode classes, the same in
# Java, RE2 and Python, so every engine normalises a text alike.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def normalize_text(c: Column) -> Column:
    """Lower case, single blanks, trimmed, then punctuation dropped (in that order)."""
    spaced = F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))
    return F.regexp_replace(spaced, NOT_WORD, "")


def query_hash(c: Column) -> Column:
    return F.md5(F.encode(normalize_text(c), "UTF-8"))


def word_count(c: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(c, BLANKS, " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def preview(c: Column, n: int = 50) -> Column:
    return F.substring(c, 1, n)


# Bytes per size unit; longer units are tried first.
SIZE_UNITS = (
    ("TB", 1024**4), ("GB", 1024**3), ("MB", 1024**2), ("KB", 1024), ("B", 1),
    ("T", 1024**4), ("G", 1024**3), ("M", 1024**2), ("K", 1024),
)


def parse_size(c: Column) -> Column:
    """Bytes of a size such as ``"2.5GB"``; null where it is not a size."""
    text = F.upper(F.trim(c))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([KMGT]?B|[KMGT])?$", 1)
    unit = F.regexp_extract(text, r"([KMGT]?B|[KMGT])$", 1)
    factors = F.create_map(*[F.lit(x) for pair in (("", 1), *SIZE_UNITS) for x in (pair[0], float(pair[1]))])
    return F.when(number != "", (number.cast("double") * factors[unit]).cast("bigint"))


# What page_text removes or decodes, in this order.
PAGE_STEPS = (
    (r"(?is)<(script|style|nav|head|footer)\b[^>]*>.*?</(script|style|nav|head|footer)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<[^>]*>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
    (BLANKS, " "),
)


def page_text(c: Column) -> Column:
    for pattern, replacement in PAGE_STEPS:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(c)


def chunk_starts(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Start offsets of fixed windows; the last one ends at the end of the text."""
    last = F.greatest(F.lit(0), F.length(text) - F.lit(overlap + 1))
    return F.sequence(F.lit(0), last, F.lit(size - overlap))
