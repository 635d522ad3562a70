"""Ordered folds: state handed from row to row, spread over range slices.

The rows are range-partitioned on (group, order), so a huge group is cut into
many consecutive slices. Only groups that cross a slice boundary need a
hand-over. Where a fold can say what a slice does to any entering state (its
transfer function, a small table), every slice says so once, the tables are
applied one after the other, and the number of jobs does not depend on slices
or data. Other folds guess: their part of a slice is folded with a guessed
entering state, the leaving states (one per slice) are handed on, and slices
whose entering state turned out different are folded again, until every
hand-over agrees, which is exactly the sequential result; that can take as many
rounds as there are slices. A last pass then emits. Memory per task: one Arrow
batch and one state, or one slice's transfer function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage_ordered

_SUMMARY = "_slice int, leaving string"


@dataclass(frozen=True)
class Fold:
    """``advance(state, columns) -> (state, outputs)`` over consecutive rows of one group.

    ``columns`` maps each input name to a list or numpy array; ``outputs`` is a
    list of equally long lists, one per field of ``result``. States must go
    through JSON unchanged. ``transfer(columns)`` of all rows of a slice gives
    sorted ``(upto, leaving)`` numbers and ``apply(state, upto, leaving)`` the
    state that leaves, for states that are null or one whole number.
    """

    inputs: tuple[str, ...]
    result: T.StructType
    start: Callable[[], Any]
    advance: Callable[[Any, dict[str, Any]], tuple[Any, list]]
    transfer: Callable[[dict[str, Any]], tuple[np.ndarray, np.ndarray]] | None = None
    apply: Callable[[Any, np.ndarray, np.ndarray], Any] | None = None


def _column(batch: pa.RecordBatch, name: str):
    array = batch.column(batch.schema.get_field_index(name))
    if array.null_count == 0 and (pa.types.is_integer(array.type) or pa.types.is_floating(array.type)):
        return array.to_numpy()
    return array.to_pylist()


def _runs(batch: pa.RecordBatch):
    """(slice, group, start, stop) for each stretch of equal (slice, group)."""
    slices = batch.column(batch.schema.get_field_index("_slice")).to_numpy()
    groups = batch.column(batch.schema.get_field_index("_group")).to_pylist()
    names = np.asarray(groups, dtype=object)
    change = np.flatnonzero((names[1:] != names[:-1]) | (slices[1:] != slices[:-1])) + 1
    bounds = [0, *change.tolist(), len(groups)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield int(slices[a]), groups[a], a, b


def _walk(fold: Fold, entering: dict[int, Any], batches, on_run, on_slice_end) -> Iterator:
    slice_id = group = first = None
    state = None
    for batch in batches:
        columns = {name: _column(batch, name) for name in fold.inputs}
        outputs: list[list] = [[] for _ in fold.result.fields]
        for s, g, a, b in _runs(batch):
            if s != slice_id:
                if slice_id is not None:
                    yield from on_slice_end(slice_id, state)
                slice_id, first, group = s, g, None
            if g != group:
                known = entering.get(s) if g == first and group is None else None
                state = json.loads(known) if known is not None else fold.start()
                group = g
            state, out = fold.advance(state, {k: v[a:b] for k, v in columns.items()})
            for whole, part in zip(outputs, out):
                whole.extend(part)
        yield from on_run(batch, outputs)
    if slice_id is not None:
        yield from on_slice_end(slice_id, state)


def _summarise(fold: Fold, entering: dict[int, str]):
    def run(batches):
        def end(slice_id, state):
            yield pa.RecordBatch.from_arrays(
                [pa.array([slice_id], pa.int32()), pa.array([json.dumps(state)], pa.string())],
                names=["_slice", "leaving"],
            )

        yield from _walk(fold, entering, batches, lambda b, o: (), end)

    return run


def _emit(fold: Fold, entering: dict[int, str], keep: Sequence[str], arrow_types: list[pa.DataType]):
    def run(batches):
        def rows(batch, outputs):
            kept = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            made = [pa.array(list(o), type=t) for o, t in zip(outputs, arrow_types)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *fold.result.names])

        yield from _walk(fold, entering, batches, rows, lambda *a: ())

    return run


def _composed(fold: Fold, narrow: DataFrame, last_group: dict[int, str]) -> dict[int, str]:
    """State that leaves each of these slices: all transfer functions in one pass, applied in order in another.

    A state, one whole number, comes back per slice.
    """
    spark = narrow.sparkSession
    last = F.broadcast(spark.createDataFrame(list(last_group.items()), "_slice int, _group string"))  # a row per slice

    def tables(batches):
        held, at = [], None

        def out():
            columns = {n: np.concatenate([np.asarray(c[n]) for c in held]) for n in fold.inputs}
            upto, leaving = fold.transfer(columns)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]]), pa.array([upto.astype("<i8").tobytes()]), pa.array([leaving.astype("<i8").tobytes()])],
                names=["_slice", "_group", "upto", "leaving"])

        for batch in batches:
            columns = {n: _column(batch, n) for n in fold.inputs}
            for s, g, a, b in _runs(batch):
                if at is not None and (s, g) != at:
                    yield out()
                    held = []
                at = (s, g)
                held.append({n: c[a:b] for n, c in columns.items()})
        if held:
            yield out()

    def walk(batches):
        group = state = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["_group"] != group:
                    group, state = row["_group"], fold.start()
                state = fold.apply(state, np.frombuffer(row["upto"], "<i8"), np.frombuffer(row["leaving"], "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_slice"]], pa.int32()), pa.array([json.dumps(state)])], names=["_slice", "leaving"])

    found = narrow.join(last, ["_slice", "_group"], "left_semi").mapInArrow(
        tables, "_slice int, _group string, upto binary, leaving binary")
    in_order = found.repartition("_group").sortWithinPartitions("_group", "_slice")
    return {r["_slice"]: r["leaving"] for r in in_order.mapInArrow(walk, _SUMMARY).collect()}


def ordered_fold(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    slices: int | None = None,
) -> DataFrame:
    """Input columns plus ``fold.result``; rows of a group are met in ``order``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_key = F.md5(F.to_json(F.struct(*group)))
    laid_out = stage_ordered(
        df.withColumn("_group", group_key)
        .repartitionByRange(slices, "_group", *order)
        .sortWithinPartitions("_group", *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    # First and last group per slice: one row per slice, worked out without Python.
    bounds = {
        r["_slice"]: (r["lo"], r["hi"])
        for r in laid_out.groupBy("_slice").agg(F.min("_group").alias("lo"), F.max("_group").alias("hi")).collect()
    }
    order_of = sorted(bounds)
    came_from = {s: p for p, s in zip(order_of, order_of[1:]) if bounds[p][1] == bounds[s][0]}
    narrow = laid_out.select("_slice", "_group", *fold.inputs)

    def leave(slices_now, entering):
        """Leaving states of these slices, folding only the rows of their last group."""
        last = spark.createDataFrame([(s, bounds[s][1]) for s in slices_now], "_slice int, _group string")
        rows = narrow.join(F.broadcast(last), ["_slice", "_group"], "left_semi")
        found = rows.mapInArrow(_summarise(fold, entering), _SUMMARY).collect()
        return {r["_slice"]: r["leaving"] for r in found}

    handing = sorted(set(came_from.values()))
    keep = list(df.columns)
    schema = T.StructType([*df.schema.fields, *fold.result.fields])
    arrow_types = [to_arrow_type(f.dataType) for f in fold.result.fields]
    if fold.transfer is not None:
        leaving = _composed(fold, narrow, {s: bounds[s][1] for s in handing}) if handing else {}
        entering = {s: leaving[p] for s, p in came_from.items()}
        return laid_out.mapInArrow(_emit(fold, entering, keep, arrow_types), schema)
    leaving = leave(handing, {}) if handing else {}
    entering: dict[int, str] = {}
    while True:
        linked = {s: leaving[p] for s, p in came_from.items()}
        # A slice of several groups leaves the same state however it was entered.
        moved = [
            s for s in handing
            if s in linked and linked[s] != entering.get(s) and bounds[s][0] == bounds[s][1]
        ]
        entering = linked
        if not moved:
            break
        leaving.update(leave(moved, {s: linked[s] for s in moved}))

    return laid_out.mapInArrow(_emit(fold, entering, keep, arrow_types), schema)
