"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def raw_cosine(a: Column, b: Column) -> Column:
    """Unclamped; null where a norm is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [0, 1]; a zero vector is similar to nothing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw_cosine(a, b), F.lit(0.0))))


def unit(a: Column) -> Column:
    """Scale to length one; the zero vector stays as it is."""
    # The norm is bound as a lambda argument so it is worked out once per row.
    scaled = F.transform(
        F.array(norm(a)),
        lambda n: F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a),
    )
    return F.element_at(scaled, 1)


def fit(a: Column, dims: int) -> Column:
    """Cut or zero-pad to ``dims``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims).cast(schemas.VECTOR)


def fit_unit(a: Column, dims: int) -> Column:
    return unit(fit(a, dims))
