"""What the operators on embeddings share: sound vectors, matrices of them, bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FIT_BYTES = 16 << 20


def sound(vec: Column) -> Column:
    """True for vectors that are there and whose components are all there and finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def kept_type(df: DataFrame, name: str) -> Column:
    """The vectors as float or double, whichever holds what is given."""
    return F.col(name) if dict(df.dtypes)[name] == "array<float>" else F.col(name).cast("array<double>")


def numbers(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists to a matrix of doubles; a shorter vector ends in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == n * width:
        lengths = np.diff(column.offsets.to_numpy())
        if n == 0 or (lengths == width).all():
            return flat.reshape(n, width)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size; no row may be zero."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def sample(df: DataFrame, key: str, vec: str, width: int, rows: int, most_bytes: int = FIT_BYTES) -> np.ndarray:
    """About ``rows`` vectors picked by hash, at most twice as many and at most ``most_bytes``: enough to fit an order on."""
    rows = max(1, min(rows, most_bytes // (8 * max(1, width))))
    n = df.count()
    share = min(1.0, rows / max(1, n))
    picked = df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select(vec).limit(2 * rows)
    return numbers(picked.toArrow().column(0), width)
