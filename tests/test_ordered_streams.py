"""Keyed streams in event-time order over several batches, and the expiry of their state."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtide.operators.baseline import baseline_history
from logtide.operators.limiter import rate_limit
from logtide.operators.suppress import cooldown, storm_machine, suppress, suppress_slice
from logtide.settings import BaselineSettings, LimiterSettings, SuppressionSettings
from logtide.streaming.stateful import baseline_stream, cooldown_stream, limiter_stream

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ALERTS = "event_id bigint, service string, ts timestamp"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def in_batches(spark, folder, batches, schema, build):
    """Rows that the stream returns over one run per batch, and the folder of its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/out").collect()


def kept_keys(spark, folder):
    """Keys whose state is in the state store."""
    return {r.key.service for r in spark.read.format("statestore").option("stateVarName", "state").load(f"{folder}/checkpoint").select("key").collect()}


#: Three batches whose times overlap, and one that is far ahead.
BATCHES = [
    [(0, "a", at(0)), (3, "a", at(300)), (1, "b", at(100)), (6, None, at(650))],
    [(2, "a", at(200)), (5, "a", at(610)), (4, "b", at(605)), (7, "b", at(699.9995))],
    [(8, "a", at(1_250)), (9, "a", at(900)), (10, None, at(1_000))],
    [(11, "c", at(500_000))],
    [(12, "d", at(900_000))],
]


def flat(upto):
    return [r for batch in BATCHES[:upto] for r in batch]


def test_cooldown_over_batches_and_expiry(spark, tmp_path):
    folder = str(tmp_path)
    got = in_batches(spark, folder, BATCHES, ALERTS, lambda s: cooldown_stream(s, 600, delay="700 seconds"))
    batch = cooldown(spark.createDataFrame(flat(4), ALERTS), 600, tie_break=["event_id"]).collect()
    assert {r.event_id: r.allowed for r in got} == {r.event_id: r.allowed for r in batch}
    assert kept_keys(spark, folder) <= {"c"}  # a, b and the null service have left the store


def test_limiter_over_batches(spark, tmp_path):
    settings = LimiterSettings(limit=2, window=400)
    got = in_batches(spark, str(tmp_path), BATCHES, ALERTS, lambda s: limiter_stream(s, settings, delay="700 seconds"))
    batch = rate_limit(spark.createDataFrame(flat(4), ALERTS), settings).collect()
    assert {r.event_id: (r.allowed, r.current_count) for r in got} == {r.event_id: (r.allowed, r.current_count) for r in batch}


def test_baselines_over_batches_expire(spark, tmp_path):
    settings, schema = BaselineSettings(expiry=500), "service string, metric string, ts timestamp, value double"
    batches = [[(s, "m", t, float(i * i % 17)) for i, s, t in rows] for rows in BATCHES]
    got = in_batches(spark, str(tmp_path), batches, schema, lambda s: baseline_stream(s, settings, "700 seconds"))
    batch = baseline_history(spark.createDataFrame([r for b in batches[:4] for r in b], schema), settings).collect()
    assert sorted((r.ts_us, str(r.service), r.ewma, r.std_dev, r.sample_count) for r in got) == sorted(
        (round(r.ts.timestamp() * 1e6), str(r.service), r.ewma, r.std_dev, r.sample_count) for r in batch)
    assert kept_keys(spark, str(tmp_path)) <= {"c"}


@pytest.mark.parametrize("width", [50, 333])
def test_storm_slices_join_up(spark, width):
    settings = SuppressionSettings(cooldown=90, storm_window=60, storm_threshold=3, storm_cooldown=120)
    rows = [(i, f"s{i * 7 % 11}", at(i * 13 % 1_000)) for i in range(200)]
    whole = {r.event_id: (r.reason, sorted(r.storm_services), r.cooldown_until, r.storm_until)
             for r in suppress(spark.createDataFrame(rows, ALERTS), settings).collect()}
    alerts, state, got = spark.createDataFrame(rows, ALERTS), None, {}
    for low in range(0, 1_100, width):
        part = alerts.where((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(low + width))))
        decisions, state = suppress_slice(part, state, settings)
        got |= {r.event_id: (r.reason, sorted(r.storm_services), r.cooldown_until, r.storm_until) for r in decisions.collect()}
    assert got == whole


def test_storm_state_survives_its_bytes():
    machine = storm_machine(SuppressionSettings())
    state = machine.new_state()
    state.now, state.cooldown_until, state.recent, state.storm_until = 10**9, {"a": 2 * 10**9, None: 3 * 10**9, "b": 5}, {None: 10**9}, 4 * 10**9
    again = machine.load(machine.dump(state))
    assert again.cooldown_until == {"a": 2 * 10**9, None: 3 * 10**9} and again.recent == {None: 10**9} and again.storm_until == 4 * 10**9
