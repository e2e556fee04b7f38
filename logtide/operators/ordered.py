"""Ordered folds: state machines that read the rows of a key in time order.

Spark shuffles by key and sorts inside the partitions; the fold then streams over the
sorted Arrow batches and carries only the state of the current key. No key is ever held in
memory as a whole. Columns that the fold does not compute stay Arrow columns, so their
values come back exactly as they were. Callers make the keys small first: baselines run on
window rows (one per service and window, however many log lines there were), alert folds on
anomalies cut into independent islands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Arrays = dict[str, np.ndarray]


class _Columns(dict):
    """Columns of a stretch of rows as arrays, converted when they are asked for."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self._batch = batch

    def __missing__(self, name: str) -> np.ndarray:
        column = self._batch.column(name)
        value = self[name] = column.to_numpy(zero_copy_only=False)
        return value


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal to each other."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def stretches(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """Bounds of the stretches of rows with equal keys."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = True
    for k in keys:
        changed[1:] |= _changes(batch.column(k))
    starts = np.flatnonzero(changed).tolist()
    return list(zip(starts, [*starts[1:], batch.num_rows]))


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    new_state: Callable[[], object],
    step: Callable[[object, Arrays], Arrays],
    schema: StructType,
) -> DataFrame:
    """Fold every key in `order`; null is a key like any other.

    `step(state, arrays)` gets consecutive rows of one key and returns the computed columns
    for them; it may change `state`, which is passed on to the next rows of the same key.
    Columns of `schema` that `df` has are handed through untouched.
    """
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    wanted = to_arrow_schema(schema)
    given = set(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        state: object = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts: list[Arrays] = []
            for lo, hi in stretches(batch, keys):
                key = (True, *(batch.column(k)[lo].as_py() for k in keys))
                if key != current:
                    current, state = key, new_state()
                parts.append(step(state, _Columns(batch.slice(lo, hi - lo))))
            out = []
            for field in wanted:
                if field.name in given:
                    out.append(batch.column(field.name).cast(field.type))
                else:
                    values = np.concatenate([p[field.name] for p in parts])
                    out.append(pa.array(values.tolist() if values.dtype == object else values, field.type))
            yield pa.RecordBatch.from_arrays(out, schema=wanted)

    return arranged.mapInArrow(run, schema)


def with_fields(df: DataFrame, added: str, names: list[str] | None = None) -> StructType:
    """Schema of `df` (or of some of its columns) with the fields of a DDL text added."""
    kept = [df.schema[n] for n in names] if names else df.schema.fields
    return StructType([*kept, *StructType.fromDDL(added).fields])
