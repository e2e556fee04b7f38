"""Sliding-window rate limiting and repeat notifications."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.operators.chunks import same_keys
from logtide.operators.ordered import Arrays, ordered_fold, with_fields
from logtide.operators.speculate import CHUNK_ROWS, Machine, Rounds, chunk_number, fold_cut
from logtide.settings import ALERT_LIMITER, LimiterSettings

SECOND = 1_000_000


class Kept(deque):
    """Times of the calls that count, oldest first, and the time of the newest row."""

    now = -(1 << 62)


def _leaves_after(s: LimiterSettings) -> int:
    """First time, after an event, at which it no longer counts."""
    return s.window * SECOND if s.left_open else s.window * SECOND + 1


def limiter_machine(s: LimiterSettings) -> Machine:
    def dump(state: Kept) -> bytes:
        return json.dumps([t for t in state if t + _leaves_after(s) > state.now]).encode()

    return Machine(Kept, _limiter_step(s), dump, lambda raw: Kept(json.loads(raw)))


def _limiter_step(s: LimiterSettings):
    leaves_after = _leaves_after(s)

    def step(state: Kept, rows: Arrays) -> Arrays:
        times = rows["ts_us"]
        n = len(times)
        allowed = np.zeros(n, dtype=bool)
        count = np.empty(n, dtype=np.int64)
        i = 0
        while i < n:
            now = int(times[i])
            while state and state[0] + leaves_after <= now:
                state.popleft()
            if len(state) < s.limit:
                state.append(now)
                allowed[i] = True
                count[i] = len(state)
                i += 1
            else:
                # Full until the oldest entry leaves: skip there at once.
                free = i + int(np.searchsorted(times[i:], state[0] + leaves_after, side="left"))
                count[i:free] = s.limit
                i = free
        state.now = int(times[-1])
        return {**rows, "allowed": allowed, "current_count": count}

    return step


def rate_limit(calls: DataFrame, settings: LimiterSettings = ALERT_LIMITER, key: str = "service",
               time_col: str = "ts", id_col: str = "event_id", chunk_rows: int = CHUNK_ROWS,
               report: Rounds | None = None) -> DataFrame:
    """Add `allowed`, `current_count` and `remaining` to (key, time, id).

    Only allowed calls count. The fold runs on three narrow columns per island of activity, and on chunks of about
    `chunk_rows` rows where an island has many; the state of a chunk is the queue of times that count. Where the whole window before a row holds no more than the limit, every call of the
    island passes, and the island does not enter the fold at all.
    """
    narrow = calls.select(key, F.unix_micros(time_col).alias("ts_us"), F.col(id_col).alias("id"))
    # Any window touches at most two neighbouring buckets, and an empty bucket clears it.
    width = (settings.window + 1) * SECOND
    bucketed = narrow.withColumn("_bucket", F.floor(F.col("ts_us") / width).cast("bigint"))
    w = Window.partitionBy(key).orderBy("_bucket")
    adjacent = F.lag("_bucket").over(w) == F.col("_bucket") - 1
    summary = (
        bucketed.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_joined", F.coalesce(adjacent, F.lit(False)))
        .withColumn("_pair", F.col("_n") + F.when(F.col("_joined"), F.lag("_n").over(w)).otherwise(0))
        .withColumn("_island", F.sum((~F.col("_joined")).cast("bigint")).over(w))
        .withColumn("_contended", F.max(F.col("_pair") > settings.limit).over(Window.partitionBy(key, "_island")))
        .withColumn("_chunk", chunk_number(F.col("_n"), [key, "_island"], chunk_rows))
        .select(key, "_bucket", "_island", "_contended", "_chunk")
    )
    marked = same_keys(bucketed, summary, [key, "_bucket"])
    contended = marked.filter("_contended").select(key, "ts_us", "id", "_island", "_chunk")
    folded = fold_cut(contended, summary.filter("_contended"), [key], ["ts_us", "id"], limiter_machine(settings),
                      with_fields(contended, "allowed boolean, current_count bigint", [key, "ts_us", "id", "_island"]), report=report)
    # Free islands: the count is the number of calls in the window, at most two buckets.
    bound = -(settings.window * SECOND - (1 if settings.left_open else 0))
    order = Window.partitionBy(key, "_island").orderBy("ts_us")
    running = order.rangeBetween(bound, 0)
    same_time = Window.partitionBy(key, "_island", "ts_us").orderBy("id")
    ties = Window.partitionBy(key, "_island", "ts_us")
    free = marked.filter(~F.col("_contended")).select(
        key, "ts_us", "id", "_island", F.lit(True).alias("allowed"),
        (F.count("*").over(running) - F.count("*").over(ties)
         + F.row_number().over(same_time)).alias("current_count"))
    return folded.unionByName(free).select(
        key, F.timestamp_micros("ts_us").alias(time_col), F.col("id").alias(id_col),
        "allowed", "current_count", (F.lit(settings.limit) - F.col("current_count")).alias("remaining"))


class _Group:
    __slots__ = ("first", "last", "pending")

    def __init__(self) -> None:
        self.first: int | None = None
        self.last: int | None = None
        self.pending = False


def _notify_step(wait_us: int, interval_us: int, repeat_us: int):
    def step(state: _Group, rows: Arrays) -> Arrays:
        n = len(rows["ts_us"])
        notify = np.zeros(n, dtype=bool)
        for i, (now, new) in enumerate(zip(rows["ts_us"].tolist(), rows["is_new"].tolist())):
            if state.first is None:
                state.first = now
            state.pending = state.pending or new
            if state.last is None:
                due = now - state.first >= wait_us
            else:
                since = now - state.last
                due = (state.pending and since >= interval_us) or since >= repeat_us
            if due:
                notify[i], state.last, state.pending = True, now, False
        return {**rows, "notify": notify}

    return step


def group_notifications(firing: DataFrame, group: list[str], member: str, wait: int = 30,
                        interval: int = 300, repeat: int = 4 * 3_600,
                        time_col: str = "ts") -> DataFrame:
    """Which evaluations of a firing alert group send a notification.

    `firing` has one row per evaluation, group and firing member. The first notification
    goes out `wait` seconds after the group started; later ones when a new member joined
    and `interval` has passed, or after `repeat`.
    """
    seen = Window.partitionBy(*group, member).orderBy(time_col)
    rows = firing.select(*group, member, F.unix_micros(time_col).alias("ts_us"),
                         (F.row_number().over(seen) == 1).alias("_new"))
    # One row per group and evaluation; members of the same evaluation act together.
    ticks = rows.groupBy(*group, "ts_us").agg(
        F.max("_new").alias("is_new"), F.count("*").alias("members"))
    folded = ordered_fold(
        ticks, group, ["ts_us"], _Group,
        _notify_step(wait * SECOND, interval * SECOND, repeat * SECOND), with_fields(ticks, "notify boolean"))
    return folded.withColumn(time_col, F.timestamp_micros("ts_us")).drop("ts_us")
