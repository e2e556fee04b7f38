"""Keyed folds on streams in event-time order, with state that expires.

The rows of a key wait in the state store until the watermark has passed them, and are then folded in time order, whatever
micro-batches they came in. Event-time timers wake a key when its next row is due, and once more when its state can no
longer matter: then the state leaves the store. A micro-batch therefore emits exactly the rows between two watermarks, and the slices of
all batches follow each other in event time, over all keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logtide.operators.speculate import Machine
from logtide.session import use_rocksdb

STATE = T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("until_ms", T.LongType())])


def _due_ms(time_us: int) -> int:
    """A row is due once the watermark, in milliseconds, is beyond this."""
    return -(-time_us // 1_000)


@dataclass
class Ordered(StatefulProcessor):
    """Fold of each key by `machine`; its state is dropped `keep_us` after the newest row."""

    machine: Machine
    keys: list[str]
    fields: T.StructType
    time_us: str
    order: list[str]
    keep_us: int
    columns: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = self.fields.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self.fields)
        self._state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                columns = [frame[n].astype(object).where(frame[n].notna(), None).tolist() for n in self.names]
                self._waiting.appendList(list(zip(*columns)))
                first = min(x for x in (first, int(frame[self.time_us].min())) if x is not None)
        if first is not None:
            self._handle.registerTimer(_due_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, at = timerValues.getCurrentWatermarkInMs(), self.names.index(self.time_us)
        waiting = list(self._waiting.get())
        due = [r for r in waiting if _due_ms(r[at]) < mark]
        rest = [r for r in waiting if _due_ms(r[at]) >= mark]
        until = self._state.get()[1] if self._state.exists() else None
        if due:
            places = [self.names.index(n) for n in self.order]
            due.sort(key=lambda r: [(r[i] is not None, r[i]) for i in places])
            state = self.machine.load(bytes(self._state.get()[0])) if until is not None else self.machine.new_state()
            arrays = {n: np.array(c, dtype=None if isinstance(f.dataType, T.NumericType) and None not in c else object)
                      for n, f, c in zip(self.names, self.fields, zip(*due))}
            for name, value in zip(self.keys, key):
                arrays[name] = np.full(len(due), value, dtype=object)
            out = self.machine.step(state, arrays)
            until = _due_ms(due[-1][at] + self.keep_us)
            self._state.update((self.machine.dump(state), until))
            if rest:
                self._waiting.put(rest)
            else:
                self._waiting.clear()
            yield pd.DataFrame({c: out[c] if c in out else arrays[c] for c in self.columns})
        if until is not None and until < mark:
            self._state.clear()
            until = None
        wake = [_due_ms(min(r[at] for r in rest))] if rest else []
        if until is not None:
            wake.append(until)
        for time in wake:
            self._handle.registerTimer(time)

    def close(self) -> None:
        pass


def ordered_stream(rows: DataFrame, keys: list[str], time_col: str, delay: str, machine: Machine, time_us: str, order: list[str],
                   keep_us: int, schema: str) -> DataFrame:
    """Fold a stream by `keys` in event-time order; rows may be up to `delay` behind the newest one, later ones are dropped.

    `rows` has `time_col` and what the machine reads, `time_us` (microseconds) among it; the result has the columns of `schema`. It
    lags `delay` behind the newest row.
    """
    use_rocksdb(rows.sparkSession)
    fields = T.StructType([f for f in rows.schema if f.name not in (*keys, time_col)])
    columns = T.StructType.fromDDL(schema).names
    processor = Ordered(machine, keys, fields, time_us, order, keep_us, columns)
    return rows.withWatermark(time_col, delay).groupBy(*[F.col(k) for k in keys]).transformWithStateInPandas(
        processor, schema, "Append", "EventTime")
