"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, a row gets the index
of its cell on the Hilbert curve through that grid, rows are sorted by curve
index, and the sorted run is cut into shards whose row counts differ by one at
most. Neighbours on the curve are neighbours in every dimension, so the files
of a shard cover narrow ranges of all columns and can be skipped by any of them.

The order is (curve index, text hash, doc_id), so a cell with a third of all
rows is cut like any other stretch, and equal texts of one cell lie together.
Ranks come from range partitions: position inside the partition plus the rows
before it, of which there is one count per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.ordering import SLICE, row_slices, running_sum
from ..session import stage
from .common import pack, packed, partitions, unpack

DIMENSIONS = ("source", "lang", "n_chars")
BROADCAST_VALUES, BROADCAST_BYTES = 100_000, 16 << 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one row per point, ``bits`` bits per column."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(axes)
    # Turn each level's cube so that the curve runs through it unbroken, from the coarsest level on.
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (axes[i] >> level) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    # Gray code across the axes, then interleave their bits.
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    index = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((axes[i] ^ flip) >> level) & 1)
    return index


def _value_bins(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, bin) of a string column: values in order, each at the share of rows before it, null first.

    One row per distinct value; the running count goes over range partitions,
    so a column with a value per row is spread as the rows are.
    """
    counts = docs.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    laid = row_slices(counts, ["_all"], ["_value"])
    total = laid.agg(F.sum("_n")).first()[0] or 1
    summed = running_sum(laid, ["_all"], ["_value"], "_n", F.col(SLICE), "_upto")
    return stage(summed.select("_value", F.floor((F.col("_upto") - F.col("_n")) * (1 << bits) / total).cast("double").alias("_bin")), "value-bins")


def quantise(docs: DataFrame, dimensions: Sequence[str], bits: int) -> DataFrame:
    """Adds ``_curve``: bins of about equal rows per dimension, then the curve index.

    Strings are placed by their rank among all values, numbers by 2**bits - 1
    quantiles; null takes the lowest bin.
    """
    kinds = dict(docs.dtypes)
    measures = [F.lit(0.0) if kinds[d] == "string" else F.coalesce(F.col(d).cast("double"), F.lit(-1.0)) for d in dimensions]
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = docs.select(*[m.alias(f"_m{i}") for i, m in enumerate(measures)]).agg(
        *[F.percentile_approx(f"_m{i}", at).alias(f"c{i}") for i in range(len(dimensions))]).first()
    cuts = [np.unique(np.asarray(c if c is not None else [], float)) for c in found]
    for i, d in enumerate(dimensions):
        if kinds[d] == "string":
            bins = _value_bins(docs, d, bits)
            size = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_value")).alias("bytes")).first()
            few = size["n"] <= BROADCAST_VALUES and (size["bytes"] or 0) <= BROADCAST_BYTES
            docs = docs.join(F.broadcast(bins) if few else bins, F.col(d).eqNullSafe(F.col("_value")), "left").drop("_value")
            docs = docs.withColumnRenamed("_bin", f"_bin{i}")
            cuts[i] = np.arange(1.0, 1 << bits)
            measures[i] = F.col(f"_bin{i}")

    @F.pandas_udf("bigint")
    def curve(*columns: pd.Series) -> pd.Series:
        # A string's bin k lies at or above k cuts, a number's above them.
        cells = [
            np.searchsorted(c, s.to_numpy(float), side="right" if kinds[d] == "string" else "left")
            for d, c, s in zip(dimensions, cuts, columns)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return docs.withColumn("_curve", curve(*measures)).drop(*[f"_bin{i}" for i in range(len(dimensions))])


def hilbert_shards(
    docs: DataFrame, shards: int = 8, dimensions: Sequence[str] = DIMENSIONS, bits: int = 5, carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, curve, rank, shard, slot and the columns in ``carry``.

    ``size`` is UTF-8 bytes plus one; ``shard`` holds ``rank * shards // rows``,
    so counts differ by one at most; ``slot`` counts from 0 in each shard.

    Nulls: null text is an empty one (size 1, crc32 of nothing); null dimensions
    take the lowest bin; null doc_id sorts first. Rows alike in everything get
    neighbouring slots. Very long texts are only measured and hashed. Columns
    in ``carry`` with a name of this operator's own are left out. Empty input
    gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "size", "text_crc32", "curve", "rank", "shard", "slot")]
    kept = dict.fromkeys(["doc_id", "text", *dimensions])
    cells = quantise(docs.select(*kept, *pack(names)), dimensions, bits).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.col("_curve").alias("curve"), F.xxhash64(text).alias("_text_hash"), *packed(names),
    )
    # Range partitioning reads its input twice: narrow rows are written first, carried columns are not worth a copy.
    narrow = cells if names else stage(cells, "shard-cells")
    order = ["curve", "_text_hash", "doc_id", "size", "text_crc32"]
    placed = stage(
        narrow.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)),
        "shard-order",
    )
    # One row per range partition.
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_rows"))
    ranked = placed.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + F.col("_at"))
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div _rows").cast("int"))
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id", "size", "text_crc32", "curve", "rank", "shard", (F.col("rank") - first).cast("bigint").alias("slot"), *unpack(names))


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder per shard, rows in curve order, so that file statistics are narrow in every dimension."""
    spark = placed.sparkSession
    (placed.repartitionByRange(partitions(spark), "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def manifest(placed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows, bytes and the range of every dimension, per shard."""
    ranges = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)
