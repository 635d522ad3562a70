"""Order-dependent columns that stay spread out when one group is huge.

A plain window over a group puts the whole group in one task. Here a group is
cut along its own order into slices of about equal numbers of rows
(:func:`row_slices`): the window runs inside (group, slice), one small row per
slice carries the rest across, and a window over those rows puts both together.
Results are those of the plain window. Any other slices that sort as the order
does will do, but may hold any number of rows.

The input is read twice (once for the slice rows), so stage it first where it
is costly to work out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_partitions, stage

SLICE = "_row_slice"


def row_slices(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = SLICE) -> DataFrame:
    """Adds the number of the range partition on (group, order) that a row is in, and writes the rows out.

    Partitions have about equal numbers of rows however those lie in time, and
    their numbers ascend with the order inside a group. Their count is that of
    ``spark.sql.shuffle.partitions``; it is named, so that small partitions are
    not merged by their bytes.
    """
    laid = df.repartitionByRange(shuffle_partitions(df.sparkSession), *group, *order).withColumn(name, F.spark_partition_id())
    return stage(laid, "row-slices")


def _names(n: int) -> list[str]:
    return [f"_slice{i}" for i in range(n)]


def _sliced(df: DataFrame, slices: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = _names(len(slices))
    return df.withColumns(dict(zip(names, slices))), names


def _directed(names: Sequence[str], descending: Sequence[bool]) -> list[Column]:
    return [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(names, descending)]


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    slices: Sequence[Column],
    descending: Sequence[bool] | None = None,
    name: str = "rank",
) -> DataFrame:
    """1-based position by ``order``; ``slices`` must sort the way ``order`` does."""
    descending = descending or [False] * len(slices)
    tagged, names = _sliced(df, slices)
    keys = [*group, *names]
    earlier = (
        Window.partitionBy(*group)
        .orderBy(*_directed(names, descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        tagged.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", *names)
    )


def previous_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_by: Column,
    name: str = "previous",
) -> DataFrame:
    """``lag(value)`` by ascending ``order``."""
    tagged, (s,) = _sliced(df, [slice_by])
    keys = [*group, s]
    order_key = F.struct(*order)
    across = Window.partitionBy(*group).orderBy(s)
    carried = (
        tagged.groupBy(*keys)
        .agg(F.max_by(F.col(value), order_key).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    local = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return (
        tagged.withColumn("_local", local)
        .join(carried, keys)
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried", s)
    )


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_by: Column,
    name: str = "running",
) -> DataFrame:
    """Inclusive running total by ascending ``order``."""
    tagged, (s,) = _sliced(df, [slice_by])
    keys = [*group, s]
    earlier = Window.partitionBy(*group).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    local = F.sum(value).over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        tagged.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", s)
    )
