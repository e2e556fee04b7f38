"""Keyed state on streams: baselines, cooldown and rate limit.

The state of a key is a handful of numbers, kept in the state store with the same rules as
the batch folds. Without a `delay`, rows of one micro-batch are taken in time order per key and come out at once; the state
stays. With a `delay`, rows are folded in event-time order over all batches and state that no longer matters leaves
the store (`streaming.ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logtide.operators.baseline import HISTORY_SCHEMA, _Baseline, _baseline_step
from logtide.operators.limiter import Kept, _limiter_step, limiter_machine
from logtide.operators.suppress import _cooldown_step, _Last, cooldown_machine
from logtide.session import use_rocksdb
from logtide.settings import ALERT_LIMITER, BaselineSettings, LimiterSettings
from logtide.streaming.ordered import ordered_stream

SECOND = 1_000_000


def _in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch."""
    return pd.concat(list(batches)).sort_values(order)


def _arrays(rows: pd.DataFrame) -> dict:
    return {c: rows[c].to_numpy() for c in rows.columns}


class BaselineProcessor(StatefulProcessor):
    """Baseline state per (service, metric)."""

    SCHEMA = T.StructType([
        T.StructField("mean", T.DoubleType()), T.StructField("std_dev", T.DoubleType()),
        T.StructField("ewma", T.DoubleType()), T.StructField("sample_count", T.LongType()),
        T.StructField("last_us", T.LongType()),
    ])

    def __init__(self, settings: BaselineSettings = BaselineSettings()) -> None:
        self._settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("baseline", self.SCHEMA)
        self._step = _baseline_step(self._settings)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = _Baseline()
        if self._state.exists():
            state.mean, state.std, state.ewma, state.count, state.last = self._state.get()
        out = self._step(state, _arrays(_in_order(rows, ["ts_us"])))
        self._state.update((state.mean, state.std, state.ewma, state.count, state.last))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class CooldownProcessor(StatefulProcessor):
    """Time of the last allowed alert per key."""

    def __init__(self, seconds: int, columns: list[str]) -> None:
        self._seconds, self._columns = seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))
        self._step = _cooldown_step(self._seconds * SECOND)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = _Last()
        if self._state.exists():
            state.at = self._state.get()[0]
        out = self._step(state, _arrays(_in_order(rows, ["at_us", "id"])))
        if state.at is not None:
            self._state.update((int(state.at),))
        yield pd.DataFrame(out)[self._columns]

    def close(self) -> None:
        pass


class LimiterProcessor(StatefulProcessor):
    """Times of the calls that count against the limit, at most `limit` of them."""

    def __init__(self, settings: LimiterSettings, columns: list[str]) -> None:
        self._settings, self._columns = settings, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getListState("kept", T.StructType([T.StructField("at", T.LongType())]))
        self._step = _limiter_step(self._settings)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = Kept(row[0] for row in self._state.get())
        out = self._step(kept, _arrays(_in_order(rows, ["ts_us", "id"])))
        self._state.put([(int(t),) for t in kept])
        yield pd.DataFrame(out)[self._columns]

    def close(self) -> None:
        pass


def baseline_stream(samples: DataFrame, settings: BaselineSettings = BaselineSettings(), delay: str | None = None) -> DataFrame:
    """Baseline history of a stream of (service, metric, ts, value)."""
    if delay is not None:
        from logtide.streaming.events import history_stream

        return history_stream(samples, delay, settings)
    use_rocksdb(samples.sparkSession)
    narrow = samples.select("service", "metric", F.unix_micros("ts").alias("ts_us"),
                            F.col("value").cast("double").alias("value"))
    return narrow.groupBy("service", "metric").transformWithStateInPandas(
        BaselineProcessor(settings), HISTORY_SCHEMA, "Append", "None")


def cooldown_stream(alerts: DataFrame, seconds: int = 600, time_col: str = "ts",
                    id_col: str = "event_id", delay: str | None = None) -> DataFrame:
    """Cooldown decisions (service, id, allowed) on a stream of alerts."""
    use_rocksdb(alerts.sparkSession)
    narrow = alerts.select("service", F.unix_micros(time_col).alias("at_us"), F.col(id_col).alias("id"))
    id_type = narrow.schema["id"].dataType.simpleString()
    if delay is not None:
        return ordered_stream(narrow.withColumn("ts", F.timestamp_micros("at_us")), ["service"], "ts", delay, cooldown_machine(seconds), "at_us",
                              ["at_us", "id"], seconds * SECOND, f"service string, id {id_type}, allowed boolean").withColumnRenamed("id", id_col)
    return narrow.groupBy("service").transformWithStateInPandas(
        CooldownProcessor(seconds, ["service", "id", "allowed"]),
        f"service string, id {id_type}, allowed boolean", "Append", "None").withColumnRenamed("id", id_col)


def limiter_stream(calls: DataFrame, settings: LimiterSettings = ALERT_LIMITER, key: str = "service",
                   time_col: str = "ts", id_col: str = "event_id", delay: str | None = None) -> DataFrame:
    """Limiter decisions (key, id, allowed, current_count) on a stream of calls."""
    use_rocksdb(calls.sparkSession)
    narrow = calls.select(key, F.unix_micros(time_col).alias("ts_us"), F.col(id_col).alias("id"))
    id_type = narrow.schema["id"].dataType.simpleString()
    key_type = narrow.schema[key].dataType.simpleString()
    if delay is not None:
        return ordered_stream(
            narrow.withColumn("ts", F.timestamp_micros("ts_us")), [key], "ts", delay, limiter_machine(settings), "ts_us", ["ts_us", "id"],
            settings.window * SECOND + 1, f"{key} {key_type}, id {id_type}, allowed boolean, current_count bigint").withColumnRenamed("id", id_col)
    return narrow.groupBy(key).transformWithStateInPandas(
        LimiterProcessor(settings, [key, "id", "allowed", "current_count"]),
        f"{key} {key_type}, id {id_type}, allowed boolean, current_count bigint", "Append", "None",
    ).withColumnRenamed("id", id_col)
