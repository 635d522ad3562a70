"""Dropping repeated byte strings with a logarithmic family of suffix arrays.

Which bytes go is defined by strings of ``window`` bytes that start in two
places. Not every suffix is indexed: each start is represented by the anchor of
its window, the place in it whose ``gram`` bytes hash lowest (leftmost first).
Anchors depend on content alone, so equal windows have their anchor at the same
offset, and consecutive starts share one: about one suffix in 85 bytes is kept.

A suffix array is a table of anchors sorted by the fingerprint of the suffix's
first ``gram`` bytes, so equal heads are neighbours. It also has a fingerprint of
the context: all bytes of all windows that the anchor represents.

* A new batch gets its suffix array, which is merge-scanned (sorted join on the
  head) against every existing level and itself; heads met twice are noted.
* Levels of equal rank merge, so there are at most log2(batches) of them and an
  anchor is rewritten once per rank.

Anchors with a noted head are the only ones looked at further. Where head and
context are there twice, all their windows repeat; that settles whole copies. Of
the other contexts with a shared head one each is compared window by window: in
one task where a head has few contexts, or as rows of window hashes, counted by
Spark, where it has many. Text is read again for these only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_path, stage
from .common import fields, pack, packed, unpack

WINDOW, GRAM = 200, 32  # GRAM: a power of two, at most the window
SEGMENT = 1 << 20  # starts worked on at a time
FEW_CONTEXTS = 4096  # contexts of a head that are compared in one task
BROADCAST_HEADS, BROADCAST_RUNS = 2_000_000, 1_000_000


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place on, by doubling."""
    h = raw.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0x9E3779B185EBCA87 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return _scramble(h)


def span_hashes(grams: np.ndarray, start: np.ndarray, length: np.ndarray, gram: int) -> np.ndarray:
    """Hash of raw[start:start + length], length at least ``gram``, from the grams that tile it."""
    out = length.astype(np.uint64)
    for at in range(0, int(length.max(initial=0)), gram):
        inside = at < length
        place = start + np.minimum(at, length - gram)
        out = np.where(inside, _scramble(out * np.uint64(0x9E3779B185EBCA87) + grams[np.where(inside, place, start)]), out)
    return out


def runs_of(raw: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Runs of starts that share an anchor, over joined texts that end at ``ends``.

    Returns (start, n, head, context); every start whose window lies inside its
    text is in exactly one run.
    """
    none = np.empty(0, np.int64)
    if len(raw) < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = gram_hashes(raw, gram)
    low = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    valid = np.arange(len(anchor)) + window <= ends[owner]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    offset = anchor[start] - start
    context = span_hashes(grams, start, n - 1 + window, gram)
    context = _scramble(context ^ (offset.astype(np.uint64) << np.uint64(20)))
    return start, n, grams[anchor[start]], context


def _segments(texts: Sequence[bytes], window: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """Texts joined to about SEGMENT bytes; a longer text is cut, overlapping by a window.

    Yields ([(row, place in the text, place in the joined bytes)], bytes, ends).
    """
    places, parts, total = [], [], 0
    for row, raw in enumerate(texts):
        for at in range(0, max(1, len(raw)), SEGMENT):
            piece = raw[at:at + SEGMENT + window - 1]
            if len(piece) < window:
                continue
            places.append((row, at, total))
            parts.append(piece)
            total += len(piece)
            if total >= SEGMENT:
                yield places, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                places, parts, total = [], [], 0
    if parts:
        yield places, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


_ANCHORS = "head bigint, context bigint, doc bigint, start bigint, n int"


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(head, context, doc, start, n) of every run, from (doc, raw)."""

    def find(batches):
        for batch in batches:
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            for places, raw, ends in _segments([t or b"" for t in batch.column("raw").to_pylist()], window):
                start, n, head, context = runs_of(raw, ends, window, gram)
                row, at, base = (np.array(x, np.int64) for x in zip(*places))
                own = np.searchsorted(ends, start, side="right")
                yield pa.RecordBatch.from_arrays([
                    pa.array(head.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc[row[own]]),
                    pa.array(start - base[own] + at[own]), pa.array(n.astype(np.int32)),
                ], ["head", "context", "doc", "start", "n"])

    return docs.mapInArrow(find, _ANCHORS)


def _write_sorted(rows: DataFrame, name: str) -> DataFrame:
    """A suffix array: dealt by head, a head with very many places over several tasks, and sorted; written once."""
    path = new_path(rows.sparkSession, name)
    rows.hint("rebalance", "head").sortWithinPartitions("head", "context").write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(_ANCHORS).parquet(path)


class Family:
    """Suffix arrays by rank; a level of rank r holds 2**r batches."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.met: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        array = _write_sorted(batch, "suffix-batch")
        found = [array.groupBy("head").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("head")]
        found += [array.select("head").join(level.select("head"), "head", "left_semi").distinct() for level in self.levels.values()]
        met = found[0]
        for more in found[1:]:
            met = met.union(more)
        self.met.append(stage(met, "suffix-met"))
        rank, merged = 0, array
        while rank in self.levels:
            merged, rank = merged.union(self.levels.pop(rank)), rank + 1
        self.levels[rank] = _write_sorted(merged, "suffix-level") if rank else array

    def heads(self) -> DataFrame:
        """Heads that stand in two places of all batches so far."""
        met = self.met[0]
        for more in self.met[1:]:
            met = met.union(more)
        return stage(met.distinct(), "suffix-heads")

    def rows(self) -> DataFrame:
        frames = list(self.levels.values())
        out = frames[0]
        for more in frames[1:]:
            out = out.union(more)
        return out


_PARTS = "doc bigint, start bigint, n int"


def _parts(doc: np.ndarray, start: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Hit starts as runs: rows of (doc, start) in order."""
    doc, start = doc[hit], start[hit]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(doc)]])).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(n)], ["doc", "start", "n"])


def window_hashes(contexts: Sequence[bytes], n: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of contexts of n + window - 1 bytes."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.concatenate([[0], np.cumsum(n + window - 1)[:-1]])
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, span_hashes(gram_hashes(raw, gram), base[row] + within, np.full(len(row), window, np.int64), gram)


def _compare(texts: DataFrame, contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, start, n) of starts in ``contexts`` whose window is in another of the same head.

    ``contexts``: (head, doc, start, n, many). Two contexts that share a window
    have the same head, so windows are compared by head and hash.
    """
    few = contexts.count() <= BROADCAST_RUNS
    wanted = contexts.groupBy("doc").agg(F.collect_list(F.struct("head", "start", "n", "many")).alias("asked"))
    rows = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, raw, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "raw", "asked"))):
                out += [(a["head"], doc, a["start"], a["n"], a["many"], raw[a["start"]:a["start"] + a["n"] + window - 1]) for a in asked]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))],
                    ["head", "doc", "start", "n", "many", "bytes"])

    cuts = stage(rows.select("doc", "raw", "asked").mapInArrow(
        cut, "head bigint, doc bigint, start bigint, n int, many boolean, bytes binary"), "suffix-contexts")

    def together(batches):
        """Contexts come sorted by head; those of one head are held at a time."""
        waiting, at = [], None

        def work():
            n = np.array([r["n"] for r in waiting], np.int64)
            row, h = window_hashes([r["bytes"] for r in waiting], n, window, gram)
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            doc, start = (np.array([r[c] for r in waiting], np.int64) for c in ("doc", "start"))
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            return _parts(doc[row], start[row] + within, count[inverse] > 1)

        for batch in batches:
            for r in batch.to_pylist():
                if r["head"] != at and waiting:
                    yield work()
                    waiting = []
                at = r["head"]
                waiting.append(r)
        if waiting:
            yield work()

    def apart(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(np.int64)
            row, h = window_hashes(batch.column("bytes").to_pylist(), n, window, gram)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column("head").to_numpy()[row]), pa.array(h.view(np.int64)), pa.array(batch.column("doc").to_numpy()[row]),
                pa.array(batch.column("start").to_numpy()[row] + within)], ["head", "hash", "doc", "start"])

    columns = ["head", "doc", "start", "n", "bytes"]
    small = cuts.filter("not many").select(*columns).repartition("head").sortWithinPartitions("head", "doc", "start").mapInArrow(together, _PARTS)
    hashed = cuts.filter("many").select(*columns).mapInArrow(apart, "head bigint, hash bigint, doc bigint, start bigint")
    twice = hashed.groupBy("head", "hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    large = hashed.join(twice, ["head", "hash"]).select("doc", "start", F.lit(1).alias("n"))
    return small.union(large)


def repeated_starts(texts: DataFrame, batches: int, window: int, gram: int) -> DataFrame:
    """(doc, start, n): maximal runs of starts whose window starts elsewhere too, from (doc, raw)."""
    family = Family()
    for i in range(batches):
        family.add(anchors(texts.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i), window, gram))
    heads = family.heads()
    few = heads.count() <= BROADCAST_HEADS
    hit = stage(family.rows().join(F.broadcast(heads) if few else heads, "head", "left_semi"), "suffix-hits")
    classes = stage(hit.groupBy("head", "context").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc", "start", "n")).alias("one")), "suffix-classes")
    several = stage(classes.groupBy("head").agg(F.count(F.lit(1)).alias("_contexts")).filter("_contexts > 1"), "suffix-several")
    ones = classes.join(several, "head").select("head", "one.*", (F.col("_contexts") > FEW_CONTEXTS).alias("many"))
    alike = classes.filter("_n > 1").select("head", "context")
    whole = hit.join(alike, ["head", "context"]).select("doc", "start", "n")
    found = whole.union(_compare(texts, stage(ones, "suffix-ones"), window, gram))
    order = Window.partitionBy("doc").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = islands.withColumn("_run", F.sum("_new").over(order)).groupBy("doc", "_run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("_end"))
    return stage(islands.select("doc", "start", (F.col("_end") - F.col("start")).alias("n")), "suffix-runs")


def drop_repeats(
    docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 3, carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed: start, end), kept (bytes) and the columns in ``carry``.

    Removes every byte inside a string of ``window`` bytes that also starts
    elsewhere, in this document or another; matches stay inside a document.
    Strings are compared by 64-bit hashes of head and content.

    Nulls: null text is empty. A null doc_id is an id. Where a doc_id is not
    unique, rows are told apart by doc_id and text; whole repeated rows repeat
    each other and lose all that a window covers. A very long text is cut into
    grams in its own row. Columns in
    ``carry`` with a name of this operator's own are left out; no other column is
    read. Empty input gives no rows.
    """
    names = [c for c in carry if c not in ("doc_id", "n_bytes", "spans", "kept")]
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    most = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    unique = (most[0] or 0) <= 1 and not most[1]
    uid = F.col("doc_id").cast("bigint") if unique else F.xxhash64("doc_id", "text")
    rows = docs.select(uid.alias("doc"), "doc_id", raw.alias("raw"), *pack(names))
    runs = repeated_starts(rows.select("doc", "raw"), batches, window, gram)
    few = runs.count() <= BROADCAST_RUNS
    spans = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + window - 1).alias("end")))).alias("cut"))
    joined = rows.join(F.broadcast(spans) if few else spans.hint("shuffle_hash"), "doc", "left")
    columns = ["doc_id", *packed(names)]

    def drop(batches_):
        for batch in batches_:
            sizes, removed, kept = [], [], []
            for raw, cuts in zip(batch.column("raw").to_pylist(), batch.column("cut").to_pylist()):
                merged: list[list[int]] = []
                for c in cuts or ():
                    if merged and c["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c["end"])
                    else:
                        merged.append([c["start"], c["end"]])
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [
                    pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary())], [*columns, "n_bytes", "spans", "kept"])

    shape = fields(rows, columns, "n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return joined.mapInArrow(drop, shape).select("doc_id", "n_bytes", "spans", "kept", *unpack(names))
