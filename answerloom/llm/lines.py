"""Dropping lines that repeat across documents, with two Bloom filters.

A first pass sets the bits of every line key it has seen once; keys met again
go into a second filter. Tasks merge their filters piece by piece: what is set
on both sides was seen twice. A second pass sends on only the keys that the
second filter suspects, as a digest and a doc_id; an aggregation confirms them
and finds the first document; a third pass drops lines.

The filters have no false negatives, so whatever their fill, results are exact;
a crowded filter only makes more keys travel. They are sized by the input and
bounded by ``max_bits``. A key is compared by its 128-bit BLAKE2b digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import fields, pack, packed, unpack

PIECE = 1 << 16  # bytes of a filter that are merged at a time
HASHES = 4
LAST = (1 << 63) - 1  # stands for a null doc_id


def line_keys(raw: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the digest of each key (None where it is too short)."""
    lines = raw.split(b"\n")
    digests: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()  # of bytes: strips ASCII white space, lower-cases A-Z only
        long = len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars)
        digests.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return lines, digests


def _bits(halves: np.ndarray, m: int) -> np.ndarray:
    """Bit positions, one row per digest, by double hashing of its two halves."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(m - 1)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def _all_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("raw").to_pylist()]


def _filters(batches: Iterator[pa.RecordBatch], m: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(m // 8, np.uint8), np.zeros(m // 8, np.uint8)
    for batch in batches:
        found: list[bytes] = []
        for raw in _raws(batch):
            found += {d for d in line_keys(raw, min_chars)[1] if d is not None}
        if not found:
            continue
        halves = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        halves, n = np.unique(halves, axis=0, return_counts=True)
        at = _bits(halves, m)
        _set(twice, at[(n > 1) | _all_set(once, at)])
        _set(once, at)
    pack = zstandard.ZstdCompressor(level=1).compress
    for i in range(0, m // 8, PIECE):
        if once[i:i + PIECE].any():
            yield pa.RecordBatch.from_arrays([
                pa.array([i // PIECE], pa.int32()), pa.array([pack(once[i:i + PIECE].tobytes())]),
                pa.array([pack(twice[i:i + PIECE].tobytes())]),
            ], ["piece", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by piece; one piece is held at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    piece, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([
            pa.array([piece], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(twice.tobytes())])
        ], ["piece", "twice"])

    for batch in batches:
        for row in batch.to_pylist():
            o, t = (np.frombuffer(unpack(row[c]), np.uint8) for c in ("once", "twice"))
            if row["piece"] != piece:
                if piece is not None and twice.any():
                    yield out()
                piece, once, twice = row["piece"], o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if piece is not None and twice.any():
        yield out()


def filter_bits(docs: DataFrame, max_bits: int) -> int:
    """A bit per eight bytes of input: some ten per line. A power of two; results don't depend on it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(max_bits.bit_length() - 1, max(23, (size // 8).bit_length()))


def seen_twice(docs: DataFrame, min_chars: int, max_bits: int) -> np.ndarray:
    """The second filter, at most ``max_bits / 8`` bytes."""
    m = filter_bits(docs, max_bits)
    raw = docs.select(F.encode("text", "utf-8").alias("raw"))
    parts = raw.mapInArrow(lambda it: _filters(it, m, min_chars), "piece int, once binary, twice binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece int, twice binary")
    bits = np.zeros(m // 8, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for row in merged.toLocalIterator():
        bits[row["piece"] * PIECE:(row["piece"] + 1) * PIECE] = np.frombuffer(unpack(bytes(row["twice"])), np.uint8)
    return bits


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_bits: int = 1 << 28, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_text and the columns in ``carry``.

    Keys (line stripped of ASCII white space, A-Z lower-cased) of at least
    ``min_chars`` code points that stand in two documents lose all their lines
    but those in the smallest doc_id.

    Nulls: null text is one empty line. Null doc_id counts as one document after
    all others. Rows with the same doc_id are one document, so a line they share
    does not repeat by that. The smallest doc_id keeps a line, so ties don't
    arise. A very long text is cut into lines in its own row. Columns in
    ``carry`` with a name of this operator's own are left out; no other column is
    read. Empty input
    gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in carry if c not in ("doc_id", "n_lines", "n_dropped", "kept_text")]
    twice = spark.sparkContext.broadcast(seen_twice(docs, min_chars, max_bits))
    m = len(twice.value) * 8
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).cast("bigint").alias("_doc"), F.encode("text", "utf-8").alias("raw"), *pack(names))

    def suspects(batches):
        for batch in batches:
            docs_at, found = [], []
            for doc, raw in zip(batch.column("_doc").to_pylist(), _raws(batch)):
                own = {d for d in line_keys(raw, min_chars)[1] if d is not None}
                found += own
                docs_at += [doc] * len(own)
            if found:
                hit = _all_set(twice.value, _bits(np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2), m))
                at = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([
                    pa.array([found[i] for i in at], pa.binary()), pa.array(np.asarray(docs_at, np.int64)[at])], ["digest", "_doc"])

    met = stage(rows.select("_doc", "raw").mapInArrow(suspects, "digest binary, _doc bigint"), "line-suspects")
    first = met.groupBy("digest").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).filter("_first < _last")
    first = stage(first, "line-firsts")  # plain shuffles on both sides below: a hot line can be split
    drops = (
        met.join(first.select("digest", "_first"), "digest").filter("_doc <> _first")
        .groupBy("_doc").agg(F.collect_set("digest").alias("drops"))
    )
    joined = rows.join(drops.hint("shuffle_hash"), "_doc", "left").drop("_doc")
    columns = ["doc_id", *packed(names)]
    shape = fields(rows, columns, "n_lines bigint, n_dropped bigint, kept binary")

    def cut(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for raw, gone in zip(_raws(batch), batch.column("drops").to_pylist()):
                if not gone:
                    n_lines.append(raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(raw)
                    continue
                lines, digests = line_keys(raw, min_chars)
                gone = set(gone)
                left = [line for line, d in zip(lines, digests) if d is None or d not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())],
                [*columns, "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(cut, shape).select(
        "doc_id", *unpack(names), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_text"))
