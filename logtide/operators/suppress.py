"""Alert suppression: per-service cooldown and system-wide storms.

Both rules are greedy in time order: whether an alert passes depends on which earlier
ones did. With storms all services interact, so the alerts are cut at silences longer than any state can live, and
a stretch that never falls silent is folded in chunks by speculation. Cooldown alone is decided per service: a chunk of time is a
map from the end of the last cooldown to the end of the next, and maps are chained before rows are marked.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logtide.operators.chunks import same_keys
from logtide.operators.ordered import Arrays, ordered_fold, stretches, with_fields
from logtide.operators.speculate import CHUNK_ROWS, Machine, Rounds, cut_islands, fold_units, speculative_fold
from logtide.session import materialise
from logtide.settings import SuppressionSettings

SECOND = 1_000_000
#: Before all times.
NEVER = -(1 << 62)


class _Last:
    """Time of the last allowed alert."""

    __slots__ = ("at",)

    def __init__(self) -> None:
        self.at: int | None = None


def _first_after(times: np.ndarray, lo: int, bound: int) -> int:
    return lo + int(np.searchsorted(times[lo:], bound, side="left"))


def _cooldown_step(cooldown_us: int):
    def step(state: _Last, rows: Arrays) -> Arrays:
        times = rows["at_us"]
        allowed = np.zeros(len(times), dtype=bool)
        # Jump from one allowed alert to the next: everything between is dropped.
        i = 0 if state.at is None else _first_after(times, 0, state.at + cooldown_us)
        while i < len(times):
            allowed[i] = True
            state.at = int(times[i])
            i = max(i + 1, _first_after(times, i, state.at + cooldown_us))
        return {**rows, "allowed": allowed}

    return step


def cooldown_machine(seconds: int) -> Machine:
    def load(raw: bytes) -> _Last:
        state = _Last()
        state.at = json.loads(raw)
        return state

    return Machine(_Last, _cooldown_step(seconds * SECOND), lambda state: json.dumps(state.at).encode(), load)


def orbit_map(times: np.ndarray, cooldown_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk with these distinct times as a map: (bounds, ends).

    If alerts may pass again from b on, the first i with bounds[i] >= b gives ends[i], the time from which they may pass after
    the chunk; beyond the last bound nothing passes in the chunk and b stays. The map is monotone and has a step for each
    different end only.
    """
    n = len(times)
    after = np.searchsorted(times, times + cooldown_us, side="left")
    # the last allowed time of the orbit that starts at each time, by pointer doubling: ends of orbits point to themselves
    last = np.where(after < n, after, np.arange(n))
    while (last != (further := last[last])).any():
        last = further
    ends = times[last] + cooldown_us
    keep = np.append(ends[1:] != ends[:-1], True) if n else np.zeros(0, bool)
    return times[keep], ends[keep]


def _orbit_maps(rows: DataFrame, unit: list[str], cooldown_us: int) -> DataFrame:
    """(unit, bounds, ends) of each chunk; a task holds the times of one chunk."""
    arranged = rows.select(*unit, "at_us").repartition(*unit).sortWithinPartitions(*unit, "at_us")
    fields = StructType([arranged.schema[n] for n in unit] + StructType.fromDDL("bounds array<bigint>, ends array<bigint>").fields)
    wanted = to_arrow_schema(fields)

    def run(batches):
        current, held = None, []

        def close():
            bounds, ends = orbit_map(np.unique(np.concatenate(held)), cooldown_us)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip([*current, bounds.tolist(), ends.tolist()], wanted)], schema=wanted)

        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("at_us").to_numpy(zero_copy_only=False)
            for lo, hi in stretches(batch, unit):
                key = tuple(batch.column(k)[lo].as_py() for k in unit)
                if key != current:
                    if held:
                        yield close()
                    current, held = key, []
                held.append(times[lo:hi])
        if held:
            yield close()

    return arranged.mapInArrow(run, fields)


class _Bound:
    __slots__ = ("at",)

    def __init__(self) -> None:
        self.at = NEVER


def _chain(state: _Bound, rows: Arrays) -> Arrays:
    """Entry bound of each chunk from the maps of those before it."""
    entries = np.empty(len(rows["bounds"]), np.int64)
    for i, (bounds, ends) in enumerate(zip(rows["bounds"], rows["ends"])):
        entries[i] = state.at
        at = int(np.searchsorted(bounds, state.at, side="left"))
        if at < len(bounds):
            state.at = int(ends[at])
    return {"_from": entries}


def _chunk_step(cooldown_us: int):
    fold = _cooldown_step(cooldown_us)

    def step(state: _Last, rows: Arrays) -> Arrays:
        if state.at is None and rows["_from"][0] != NEVER:
            state.at = int(rows["_from"][0]) - cooldown_us
        return fold(state, rows)

    return step


def cooldown(alerts: DataFrame, seconds: int, key: str = "service", time_col: str = "ts",
             tie_break: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `allowed`: no allowed alert of the key in the last `seconds`.

    A dropped alert does not extend the cooldown. A key that is never silent is cut into chunks of about `chunk_rows` rows.
    Every chunk is first made a map from the time its alerts may pass again to the time they may do so after it; the maps of a key
    are chained, one step per chunk, and the chunks are then marked in parallel.
    """
    cooldown_us = seconds * SECOND
    staged = alerts.withColumn("at_us", F.unix_micros(time_col)).withColumn(
        "_bucket", F.floor(F.col("at_us") / F.lit(max(1, cooldown_us))).cast("bigint"))
    cut = cut_islands(staged.groupBy(key, "_bucket").agg(F.count("*").alias("_n")), [key], chunk_rows)
    rows = same_keys(staged, cut, [key, "_bucket"]).drop("_bucket")
    order, island = ["at_us", *(tie_break or [])], [key, "_island"]
    if not cut.agg(F.max("_chunk")).first()[0]:
        marked = ordered_fold(rows, island, order, _Last, _cooldown_step(cooldown_us), with_fields(rows, "allowed boolean"))
    else:
        rows, unit = materialise(rows, "cooldown-rows"), [*island, "_chunk"]
        maps = _orbit_maps(rows, unit, cooldown_us)
        entries = ordered_fold(maps, island, ["_chunk"], _Bound, _chain, with_fields(maps, "_from bigint", unit))
        entered = same_keys(rows, materialise(entries, "cooldown-entries"), unit)
        marked = ordered_fold(entered, unit, order, _Last, _chunk_step(cooldown_us), with_fields(entered, "allowed boolean"))
    return marked.select(*alerts.columns, "allowed")


class _Storm:
    """`cooldown_until` by service, `recent` alerts of the storm window in time order, time of the newest row."""

    __slots__ = ("cooldown_until", "storm_until", "recent", "now")

    def __init__(self) -> None:
        self.cooldown_until: dict[str, int] = {}
        self.storm_until = NEVER
        self.recent: dict[str, int] = {}
        self.now = NEVER


DECISION = ("reason string, allowed boolean, is_storm boolean, storm_services array<string>, "
            "cooldown_until_us bigint, storm_until_us bigint")


def _storm_step(s: SuppressionSettings):
    cooldown_us, window_us = s.cooldown * SECOND, s.storm_window * SECOND
    storm_us = s.storm_cooldown * SECOND

    def step(state: _Storm, rows: Arrays) -> Arrays:
        n = len(rows["ts_us"])
        reason = np.empty(n, dtype=object)
        members = np.empty(n, dtype=object)
        cooled, stormed = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        clears, recent, current = rows["is_clear"], state.recent, list(state.recent)
        for i, (service, now) in enumerate(zip(rows["service"], rows["ts_us"].tolist())):
            while recent and recent[oldest := next(iter(recent))] <= now - window_us:
                del recent[oldest]
                current = None
            if clears[i]:
                state.storm_until = NEVER
                recent.clear()
                reason[i], current = "clear", None
            elif now < state.cooldown_until.get(service, now):
                reason[i] = "cooldown"
            elif now < state.storm_until:
                reason[i] = "storm_active"
            else:
                state.cooldown_until[service] = now + cooldown_us
                recent.pop(service, None)  # rows come by (time, service), so the newest entry is the last one
                recent[service] = now
                current = None
                reason[i] = "allowed"
                if len(recent) > s.storm_threshold:
                    state.storm_until = now + storm_us
                    reason[i] = "storm"
            if current is None:
                current = list(recent)
            members[i] = current
            cooled[i] = max(state.cooldown_until.get(service, now), now)
            stormed[i] = max(state.storm_until, now)
            state.now = now
        return {"reason": reason, "allowed": reason == "allowed", "is_storm": reason == "storm", "storm_services": members,
                "cooldown_until_us": cooled, "storm_until_us": stormed}

    return step


def _dump_storm(s: SuppressionSettings):
    def dump(state: _Storm) -> bytes:
        """What still counts after the newest row; earlier times cannot come any more."""
        cooling = sorted(((k is not None, k or "", t) for k, t in state.cooldown_until.items() if t > state.now))
        recent = [(k, t) for k, t in state.recent.items() if t > state.now - s.storm_window * SECOND]
        return json.dumps([[[k if known else None, t] for known, k, t in cooling], recent,
                           state.storm_until if state.storm_until > state.now else NEVER]).encode()

    return dump


def _load_storm(raw: bytes) -> _Storm:
    state = _Storm()
    cooling, recent, state.storm_until = json.loads(raw)
    state.cooldown_until, state.recent = dict(map(tuple, cooling)), dict(map(tuple, recent))
    return state


def suppress(alerts: DataFrame, settings: SuppressionSettings = SuppressionSettings(),
             time_col: str = "ts", id_col: str = "event_id",
             clears: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS,
             report: Rounds | None = None) -> DataFrame:
    """Decision for every alert, in the order (time, service, id).

    Adds reason (allowed, cooldown, storm, storm_active), allowed, is_storm,
    storm_services (services alerting in the storm window), cooldown_until, storm_until.
    `clears` is an optional table with a time column of operator resets of the storm state.
    Returns (service, ts, id column, decision columns); join on the id for more. A stretch without
    silence is cut into chunks of about `chunk_rows` alerts; `report` is told how they were folded.
    """
    narrow = _narrow(alerts, time_col, id_col)
    id_type = narrow.schema["id"].dataType.simpleString()
    if clears is not None:
        narrow = narrow.unionByName(clears.select(
            F.lit("").alias("service"), F.unix_micros(time_col).alias("ts_us"),
            F.lit(None).cast(id_type).alias("id"), F.lit(True).alias("is_clear")))
    machine = storm_machine(settings)
    folded = speculative_fold(narrow, [], "ts_us", ["ts_us", "service", "id"], settings.memory * SECOND, machine,
                              with_fields(narrow, DECISION), chunk_rows, report=report)
    return _decisions(folded, time_col, id_col)


def _narrow(alerts: DataFrame, time_col: str, id_col: str) -> DataFrame:
    return alerts.select("service", F.unix_micros(time_col).alias("ts_us"), F.col(id_col).alias("id"), F.lit(False).alias("is_clear"))


def _decisions(folded: DataFrame, time_col: str, id_col: str) -> DataFrame:
    return folded.filter(F.col("reason") != "clear").select(
        "service", F.timestamp_micros("ts_us").alias(time_col), F.col("id").alias(id_col),
        "reason", "allowed", "is_storm", "storm_services",
        F.timestamp_micros("cooldown_until_us").alias("cooldown_until"),
        F.timestamp_micros("storm_until_us").alias("storm_until"))


def storm_machine(settings: SuppressionSettings) -> Machine:
    return Machine(_Storm, _storm_step(settings), _dump_storm(settings), _load_storm)


def suppress_slice(alerts: DataFrame, entry: bytes | None, settings: SuppressionSettings = SuppressionSettings(),
                   time_col: str = "ts", id_col: str = "event_id") -> tuple[DataFrame, bytes | None]:
    """`suppress` for the next slice of event time: decisions, and the state to start the slice after it from.

    The state names the services that are cooling down or alerting. The alerts of a slice, those of one micro-batch, go through one task.
    """
    machine = storm_machine(settings)
    if entry is not None:
        machine.new_state = lambda: _load_storm(bytes(entry))
    narrow = _narrow(alerts, time_col, id_col).withColumn("_slice", F.lit(0))
    folded = materialise(fold_units(narrow, ["_slice"], ["ts_us", "service", "id"], None, machine, with_fields(narrow, DECISION)), "storm-slice")
    tail = folded.where(F.col("_exit").isNotNull()).select("_exit").first()
    return _decisions(folded.where(F.col("_exit").isNull()), time_col, id_col), bytes(tail[0]) if tail else entry


def suppression_counts(decisions: DataFrame) -> DataFrame:
    """Suppressed alerts by (service, reason)."""
    return (decisions.filter(F.col("reason").isin("cooldown", "storm_active"))
            .groupBy("service", "reason").agg(F.count("*").alias("suppressed")))


def remaining_ttl(decisions: DataFrame, as_of: Column, time_col: str = "ts") -> DataFrame:
    """Seconds left at `as_of` of each service's cooldown and of the storm; 0 when over.

    Rows (scope, service, ttl) with scope cooldown or storm; a storm has the service `system`.
    """
    past = decisions.filter(F.col(time_col) <= as_of)

    def left(until: str) -> Column:
        us = F.unix_micros(F.max(until)) - F.unix_micros(as_of)
        return F.greatest(F.lit(0.0), us / F.lit(1e6)).alias("ttl")

    cooling = past.groupBy("service").agg(left("cooldown_until")).select(
        F.lit("cooldown").alias("scope"), "service", "ttl")
    storm = past.agg(left("storm_until")).select(
        F.lit("storm").alias("scope"), F.lit("system").alias("service"), "ttl")
    return cooling.unionByName(storm)


def sliding_services(alerts: DataFrame, seconds: int = 60, time_col: str = "ts",
                     id_col: str = "event_id") -> DataFrame:
    """Distinct services alerting in (t - seconds, t] at every alert; no suppression.

    An alert is counted for a service when it is the service's latest one, so each alert
    covers the times from its own until it leaves the window or the service alerts again.
    The number of open covers is a running sum of +1 and -1 steps, taken in time chunks.
    """
    # The next alert of the service matters only within `seconds`, so it lies in the same or
    # the following bucket. Every alert is also shown to the bucket before its own; a busy
    # service is spread over its buckets.
    own = F.floor(F.col("_us") / (seconds * SECOND))
    w = Window.partitionBy("service", "_bucket").orderBy("_us", id_col)
    staged = (
        alerts.withColumn("_us", F.unix_micros(time_col))
        .withColumn("_bucket", F.explode(F.array(own, own - 1)))
        .withColumn("_next", F.lead("_us").over(w))
        .filter(F.col("_bucket") == own).drop("_bucket")
    )
    ends = F.least(F.col("_us") + seconds * SECOND, F.coalesce("_next", F.col("_us") + seconds * SECOND))
    steps = (
        staged.select(F.explode(F.array(
            F.struct(F.col("_us").alias("at"), F.lit(1).alias("step")),
            F.struct(ends.alias("at"), F.lit(-1).alias("step")))).alias("s"))
        .select("s.*").groupBy("at").agg(F.sum("step").alias("step"))
    )
    width = max(seconds, 3_600) * SECOND
    chunked = steps.withColumn("_chunk", F.floor(F.col("at") / width))
    inside = Window.partitionBy("_chunk").orderBy("at")
    across = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (chunked.groupBy("_chunk").agg(F.sum("step").alias("_n"))
             .withColumn("_carry", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n"))
    levels = (chunked.withColumn("_local", F.sum("step").over(inside)).join(carry, "_chunk")
              .select(F.col("at").alias("_us"), (F.col("_local") + F.col("_carry")).alias("services")))
    return staged.join(levels, "_us").drop("_us", "_next")
