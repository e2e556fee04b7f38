"""Rolling baselines per (service, metric).

The update is a recurrence in time order. Its input is one row per window and metric: a service that produces a third of
all log lines has no more rows here than any other. A long series is cut into chunks. On (ewma, variance) a chunk is the map

    ewma -> f * ewma + a,        variance -> f * variance + p + q * ewma + r * ewma^2

whose numbers come from its samples alone, so all chunks are summed up at once; the maps of a series are applied one after the
other, one step per chunk, and every chunk is then folded from its own entry state, in parallel.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from logtide.operators.chunks import same_keys
from logtide.operators.ordered import Arrays, ordered_fold, stretches
from logtide.operators.speculate import CHUNK_ROWS, Machine, fold_units
from logtide.session import materialise
from logtide.settings import FEATURES, BaselineSettings

HISTORY_SCHEMA = (
    "service string, metric string, ts_us bigint, value double, "
    "prev_ewma double, prev_std double, mean double, std_dev double, ewma double, "
    "sample_count bigint"
)


def long_features(features: DataFrame, metrics: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per (service, ts, metric)."""
    return features.unpivot(["service", "ts"], list(metrics), "metric", "value")


class _Baseline:
    __slots__ = ("mean", "variance", "std", "ewma", "count", "last")

    def __init__(self) -> None:
        self.count = 0
        self.mean = self.variance = self.std = self.ewma = 0.0
        self.last = 0


def _baseline_step(settings: BaselineSettings):
    alpha, keep = settings.alpha, 1 - settings.alpha
    expiry_us = settings.expiry * 1_000_000

    def step(state: _Baseline, rows: Arrays) -> Arrays:
        n = len(rows["value"])
        prev_ewma, prev_std = np.full(n, np.nan), np.full(n, np.nan)
        mean, std, ewma = np.empty(n), np.empty(n), np.empty(n)
        count = np.empty(n, dtype=np.int64)
        for i, (ts, x) in enumerate(zip(rows["ts_us"].tolist(), rows["value"].tolist())):
            if state.count and ts - state.last > expiry_us:
                state.count = 0
            if state.count == 0:
                state.count, state.mean, state.ewma, state.std = 1, x, x, 0.0
            else:
                prev_ewma[i], prev_std[i] = state.ewma, state.std
                deviation = x - state.ewma
                variance = keep * (state.std * state.std) + alpha * keep * (deviation * deviation)
                state.ewma = alpha * x + keep * state.ewma
                state.std = math.sqrt(variance) if variance > 0 else 0.0
                state.count += 1
                state.mean += (x - state.mean) / state.count
            state.last = ts
            mean[i], std[i], ewma[i], count[i] = state.mean, state.std, state.ewma, state.count
        return {
            "service": rows["service"], "metric": rows["metric"], "ts_us": rows["ts_us"],
            "value": rows["value"], "prev_ewma": prev_ewma, "prev_std": prev_std,
            "mean": mean, "std_dev": std, "ewma": ewma, "sample_count": count,
        }

    return step


def baseline_machine(settings: BaselineSettings) -> Machine:
    return Machine(_Baseline, _baseline_step(settings), _pack, _unpack)


def decayed_sums(x: np.ndarray, keep: float) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i] with y[-1] = 0, in blocks: one product of matrices, and one step per block."""
    block = 64
    padded = np.zeros(-(-len(x) // block) * block)
    padded[:len(x)] = x
    i = np.arange(block)
    powers = np.where(i[:, None] >= i[None], keep ** np.maximum(i[:, None] - i[None], 0), 0.0)
    inside = padded.reshape(-1, block) @ powers.T
    carry = np.empty(len(inside))
    at, whole = 0.0, keep ** block
    for n, last in enumerate(inside[:, -1].tolist()):
        carry[n] = at
        at = whole * at + last
    return (inside + carry[:, None] * keep ** (i + 1)).reshape(-1)[:len(x)]


def chunk_map(x: np.ndarray, alpha: float) -> tuple[float, ...]:
    """(f, a, p, q, r) of the samples `x`, for ewma values less `x[0]`: differences stay small, and a constant series stays exact."""
    keep, n = 1 - alpha, len(x)
    shifted = x - x[0]
    sums = alpha * decayed_sums(shifted, keep)  # the ewma after each sample from an ewma of 0
    apart = shifted - np.append(0.0, sums[:-1])  # x[i] less the ewma before it
    f = keep ** n
    return (f, float(sums[-1]), float(alpha * keep * decayed_sums(apart * apart, keep)[-1]),
            float(-2 * alpha * f * apart.sum()), f * (1 - f))


SUMMARY = ("first_us bigint, last_us bigint, first double, resets boolean, f double, a double, p double, q double, r double, "
           "n bigint, total double, tail_first double, tail_f double, tail_a double, tail_p double, tail_q double, tail_r double, tail_n bigint, "
           "tail_total double, tail_start double")
_SUMMARY_NAMES = [part.split()[0] for part in SUMMARY.split(", ")]


def _summaries(rows: DataFrame, unit: list[str], settings: BaselineSettings) -> DataFrame:
    """One row per chunk: its map, and the map of what follows the first sample after its last expiry, or its first sample."""
    arranged = rows.repartition(*unit).sortWithinPartitions(*unit, "ts_us")
    schema = StructType([arranged.schema[n] for n in unit] + StructType.fromDDL(SUMMARY).fields)
    wanted = to_arrow_schema(schema)

    def run(batches):
        current, held = None, []

        def close():
            times, values = (np.concatenate(c) for c in zip(*held))
            resets = np.flatnonzero(np.diff(times) > settings.expiry * 1_000_000)
            start = int(resets[-1]) + 1 if len(resets) else 0
            tail = values[start:]
            rest = chunk_map(tail[1:], settings.alpha) if len(tail) > 1 else (1.0, 0.0, 0.0, 0.0, 0.0)
            shift = tail[1] if len(tail) > 1 else tail[0]
            row = [*current, times[0], times[-1], values[0], bool(len(resets)), *chunk_map(values, settings.alpha), len(values), values.sum(),
                   shift, *rest, len(tail), tail.sum(), tail[0]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, wanted)], schema=wanted)

        for batch in batches:
            if not batch.num_rows:
                continue
            times, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ts_us", "value"))
            for lo, hi in stretches(batch, unit):
                key = tuple(batch.column(k)[lo].as_py() for k in unit)
                if key != current:
                    if held:
                        yield close()
                    current, held = key, []
                held.append((times[lo:hi], values[lo:hi]))
        if held:
            yield close()

    return arranged.mapInArrow(run, schema)


def _pack(state: _Baseline) -> bytes:
    return struct.pack("<4d2q", state.mean, state.variance, state.std, state.ewma, state.count, state.last)


def _unpack(raw: bytes) -> _Baseline:
    state = _Baseline()
    state.mean, state.variance, state.std, state.ewma, state.count, state.last = struct.unpack("<4d2q", raw)
    return state


def _enter(settings: BaselineSettings):
    """Fold over the summaries of a series: the entry state of each chunk."""
    def applied(ewma: float, variance: float, shift: float, f: float, a: float, p: float, q: float, r: float) -> tuple[float, float]:
        e = ewma - shift
        return f * e + a + shift, max(0.0, f * variance + p + q * e + r * e * e)

    def step(state: _Baseline, rows: Arrays) -> Arrays:
        entries = np.empty(len(rows["n"]), dtype=object)
        for i in range(len(entries)):
            row = {name: rows[name][i] for name in _SUMMARY_NAMES}
            entries[i] = _pack(state)
            maps = [row[m] for m in "fapqr"]
            if row["resets"] or not state.count or row["first_us"] - state.last > settings.expiry * 1_000_000:
                tail = [row[f"tail_{m}"] for m in "fapqr"]
                ewma, variance = applied(row["tail_start"], 0.0, row["tail_first"], *tail)
                state.count, state.mean = int(row["tail_n"]), row["tail_total"] / row["tail_n"]
            else:
                ewma, variance = applied(state.ewma, state.std * state.std, row["first"], *maps)
                total = state.mean * state.count + row["total"]
                state.count += int(row["n"])
                state.mean = total / state.count
            state.ewma, state.std, state.last = float(ewma), math.sqrt(variance), int(row["last_us"])
        return {"_entry": entries}

    return step


def baseline_history(samples: DataFrame, settings: BaselineSettings = BaselineSettings(), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """State before and after every sample of `samples` (service, metric, ts, value).

    `prev_ewma` and `prev_std` are null for the first sample and after an expiry. A series with more than `chunk_rows` samples
    between two expiries is folded in chunks; their entry states differ from the serial ones by rounding only.
    """
    narrow = samples.select("service", "metric", F.unix_micros("ts").alias("ts_us"),
                            F.col("value").cast("double").alias("value"))
    keys, schema = ["service", "metric"], StructType.fromDDL(HISTORY_SCHEMA)
    narrow = materialise(narrow, "samples")  # small beside the logs, and read again for each step
    if narrow.count() <= chunk_rows:
        folded = ordered_fold(narrow, keys, ["ts_us"], _Baseline, _baseline_step(settings), schema)
    else:
        folded = _in_chunks(narrow, keys, settings, schema, chunk_rows)
    return folded.withColumns({
        "ts": F.timestamp_micros("ts_us"),
        "prev_ewma": F.nanvl("prev_ewma", F.lit(None).cast("double")),
        "prev_std": F.nanvl("prev_std", F.lit(None).cast("double")),
    }).drop("ts_us")


def _in_chunks(narrow: DataFrame, keys: list[str], settings: BaselineSettings, schema: StructType, chunk_rows: int) -> DataFrame:
    """Each series cut evenly in time: no chunk of a regular series has more than about `chunk_rows` samples."""
    unit = [*keys, "_chunk"]
    spans = narrow.groupBy(*keys).agg(F.min("ts_us").alias("_low"), (F.max("ts_us") - F.min("ts_us") + 1).alias("_span"),
                                      F.ceil(F.count("*") / F.lit(chunk_rows)).alias("_parts"))
    part = F.floor((F.col("ts_us") - F.col("_low")) / F.ceil(F.col("_span") / F.col("_parts"))).cast("bigint")
    rows = materialise(same_keys(narrow, spans, keys).withColumn("_chunk", part)
                       .select(*unit, "ts_us", "value"), "baseline-rows")
    summaries = _summaries(rows, unit, settings)
    fields = StructType([*[summaries.schema[n] for n in unit], StructField("_entry", BinaryType())])
    entries = materialise(ordered_fold(summaries, keys, ["_chunk"], _Baseline, _enter(settings), fields), "baseline-entries")
    return fold_units(rows, unit, ["ts_us"], entries, baseline_machine(settings), schema).where("_exit is null").drop("_exit")


def running_mean(samples: DataFrame) -> DataFrame:
    """Arithmetic mean and sample count up to each sample."""
    w = (Window.partitionBy("service", "metric").orderBy("ts")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return samples.withColumns({
        "mean": F.avg("value").over(w), "sample_count": F.count("value").over(w)})


def first_seen(df: DataFrame, time_col: str = "ts") -> DataFrame:
    return df.groupBy("service").agg(F.min(time_col).alias("first_seen"))


def with_first_seen(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """Add `first_seen` to window rows, without computing them a second time."""
    return df.withColumn("first_seen", F.min(time_col).over(Window.partitionBy("service")))


def is_learning(ts: Column, seen: Column, settings: BaselineSettings = BaselineSettings()) -> Column:
    """Cold start: never seen, or first seen less than the cold-start time ago."""
    age = F.unix_micros(ts) - F.unix_micros(seen)
    return seen.isNull() | (age < settings.cold_start * 1_000_000)


def rolling_count(samples: DataFrame, keys: tuple[str, ...] = ("service", "metric"),
                  seconds: int = BaselineSettings().rolling, out: str = "window_samples") -> DataFrame:
    """Samples in the half-open range (ts - seconds, ts] of each row's key."""
    w = (Window.partitionBy(*keys).orderBy(F.unix_micros("ts"))
         .rangeBetween(-(seconds * 1_000_000 - 1), 0))
    return samples.withColumn(out, F.count("*").over(w))


def latest_baseline(history: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest state per (service, metric), optionally as of a time."""
    rows = history if as_of is None else history.filter(F.col("ts") <= as_of)
    state = F.struct("mean", "std_dev", "ewma", "sample_count", F.col("ts").alias("last_updated"))
    return (rows.groupBy("service", "metric").agg(F.max_by(state, "ts").alias("state"))
            .select("service", "metric", "state.*"))


def drop_expired(latest: DataFrame, as_of: Column,
                 settings: BaselineSettings = BaselineSettings()) -> DataFrame:
    """Leave out baselines that were last updated longer ago than the expiry."""
    age = F.unix_micros(as_of) - F.unix_micros("last_updated")
    return latest.filter(age <= settings.expiry * 1_000_000)


def service_status(history: DataFrame, as_of: Column,
                   settings: BaselineSettings = BaselineSettings()) -> DataFrame:
    """Per service: learning flag, first seen, age in hours, map of the live baselines."""
    seen = first_seen(history.filter(F.col("ts") <= as_of))
    live = drop_expired(latest_baseline(history, as_of), as_of, settings)
    state = F.struct("mean", "std_dev", "ewma", "sample_count", "last_updated")
    # One entry per metric of the feature vector.
    maps = live.groupBy("service").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", state)))).alias("metrics"))
    hours = (F.unix_micros(as_of) - F.unix_micros("first_seen")) / F.lit(3_600_000_000.0)
    return seen.join(maps, "service", "left").select(
        "service",
        is_learning(as_of, F.col("first_seen"), settings).alias("learning"),
        "first_seen", hours.alias("age_hours"), "metrics")
