"""Nothing gets lost: null keys, exact payloads, late events, rejected and undecodable input."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logtide.operators.chunks import running_count, running_max_before
from logtide.operators.limiter import rate_limit
from logtide.operators.multiline import assemble
from logtide.operators.suppress import cooldown, suppress
from logtide.operators.windows import mark_late
from logtide.plans import read
from logtide.settings import LimiterSettings, WindowSettings
from logtide.sources.readers import decode_events, kafka_options, undecodable_events
from logtide.streaming import jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def calls(spark, rows):
    return spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows], "event_id long, service string, ts timestamp")


def test_rate_limit_keeps_null_keys(spark):
    rows = [(1, None, 0), (2, None, 1), (3, None, 2), (4, "a", 0), (5, None, 100_000)]
    got = {r.event_id: r.allowed for r in rate_limit(calls(spark, rows), LimiterSettings(limit=2)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_cooldown_and_suppress_keep_null_keys(spark):
    rows = [(1, None, 0), (2, None, 599), (3, None, 600), (4, "a", 1), (5, "b", 1), (6, None, 5_000)]
    got = {r.event_id: r.allowed for r in cooldown(calls(spark, rows), 600).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    decided = {r.event_id: r.reason for r in suppress(calls(spark, rows)).collect()}
    assert decided == {1: "allowed", 2: "cooldown", 3: "allowed", 4: "allowed", 5: "allowed", 6: "allowed"}


def test_payloads_come_back_exactly(spark):
    big = 9_007_199_254_740_993
    schema = ("service string, ts timestamp, big long, price decimal(10,2), pair struct<a: int, b: string>, tags map<string, int>, "
              "list array<double>, day date")
    rows = [("a", T0, big, Decimal("1.10"), (1, "x, y"), {"k": 1}, [1.5, None], T0.date()), ("a", T0 + timedelta(seconds=1), None, None, None, None, None, None),
            (None, T0, big + 2, Decimal("3.00"), (None, None), {}, [], None)]
    out = cooldown(spark.createDataFrame(rows, schema), 600, tie_break=["big"])
    assert {f.name: f.dataType for f in out.schema} == {**{f.name: f.dataType for f in spark.createDataFrame([], schema).schema},
                                                        "allowed": out.schema["allowed"].dataType}
    got = {(r.service, r.big, r.price, r.pair, str(r.tags), str(r.list), r.day, r.allowed) for r in out.collect()}
    assert got == {("a", big, Decimal("1.10"), (1, "x, y"), "{'k': 1}", "[1.5, None]", T0.date(), True),
                   ("a", None, None, None, "None", "None", None, False), (None, big + 2, Decimal("3.00"), (None, None), "{}", "[]", None, True)}


def test_running_values_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, n, n % 4) for n in range(10)] + [("a", n, 9 - n) for n in range(10)], "k string, n long, v long")
    got = {(r.k, r.n): r.m for r in running_max_before(rows, ["k"], ["n"], F.floor(F.col("n") / 3), F.col("v"), "m").collect()}
    for n in range(10):
        assert got[None, n] == max([x % 4 for x in range(n)], default=None)
        assert got["a", n] == (9 if n else None)
    counts = {(r.k, r.n): r.c for r in running_count(rows, ["k"], ["n"], F.floor(F.col("n") / 3), F.col("v") > 1, "c").collect()}
    assert counts[None, 9] == 4 and len(counts) == 20


def test_records_of_a_source_without_a_name(spark):
    lines = spark.createDataFrame([(None, n, f"2024-01-01T00:00:0{n}Z INFO a" if n % 3 == 0 else "  at x") for n in range(9)],
                                  "source_file string, line_no long, line string")
    assert sorted(r.n_lines for r in assemble(lines).collect()) == [3, 3, 3]


def test_late_rows_without_an_arrival_number(spark):
    rows = spark.createDataFrame([(None, T0), (1, T0 + timedelta(hours=5)), (2, T0)], "seq long, event_time timestamp")
    got = {r.seq: r.is_late for r in mark_late(rows, "seq", WindowSettings(), chunk_rows=1).collect()}
    assert got == {None: False, 1: False, 2: True}


def test_lost_offsets_are_an_error():
    assert kafka_options("s", "raw-logs")["failOnDataLoss"] == "true"
    assert kafka_options("s", "raw-logs", fail_on_data_loss=False)["failOnDataLoss"] == "false"


def test_rejected_silences_are_visible(spark):
    asked = spark.createDataFrame([("a", T0, 0), ("a", T0, 5), ("b", T0, 1_441), ("c", T0, None)], "service string, ts timestamp, minutes int")
    assert [r.service for r in read.silence(asked).collect()] == ["a"]
    assert sorted((r.service, r.reason) for r in read.rejected_silences(asked).collect()) == [
        ("a", "minutes not between 1 and 1440"), ("b", "minutes not between 1 and 1440"), ("c", "minutes missing")]


def test_undecodable_events_are_dead_letters(spark):
    messages = spark.createDataFrame([("k", '{"event_id":"1"}', 0, 7), ("k", "{", 1, 8), (None, None, 2, 9), ("k", '{"service":"s"}', 3, 10)],
                                     "key string, value string, partition int, offset long")
    assert decode_events(messages).count() == 1
    assert sorted((r.offset, r.reason, r.partition) for r in undecodable_events(messages).collect()) == [
        (8, "malformed json", 1), (9, "empty message", 2), (10, "no event id", 3)]


@pytest.fixture
def ingested(spark, tmp_path):
    """Batches of (seconds, service, text) in order; a repeated batch must change nothing."""
    def run(*batches, repeat=None):
        number = 0
        for rows in batches:
            text = F.concat(F.lit('{"timestamp":"'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","service_name":"'), F.col("service"),
                            F.lit('","message":"'), F.col("message"), F.lit('"}'))
            frame = spark.createDataFrame([(T0 + timedelta(seconds=t), s, m) for t, s, m in rows], "at timestamp, service string, message string")
            messages = frame.select(F.lit("k").alias("key"), text.alias("value"), F.lit(0).alias("partition"),
                                    F.lit(number).cast("long").alias("offset"), F.col("at").alias("timestamp"))
            for _ in range(2 if repeat == number else 1):
                jobs.ingest_batch(str(tmp_path))(messages, number)
            number += 1
        logs = spark.read.parquet(f"{tmp_path}/logs")
        letters = spark.read.parquet(f"{tmp_path}/dead_letters")
        return sorted(r.message for r in logs.collect()), sorted((r.reason, r.key, r.offset) for r in letters.collect()), logs
    return run


def test_every_event_stays_in_the_logs(ingested):
    far = 10 * 365 * 86_400
    messages, letters, logs = ingested(
        [(1_000, "a", "first"), (1_000, "unknown", "nobody")], [(0, "a", "late"), (0, "unknown", "late nobody"), (990, "a", "in time")],
        [(far, "a", "future")], [(2_000, "a", "after the future")], repeat=1)
    assert messages == ["after the future", "first", "future", "in time", "late", "late nobody", "nobody"]
    assert letters == [("late event", "k", 1), ("late event", "k", 3)]
    plan = read.search_logs(logs, F.lit(T0), F.lit(T0 + timedelta(hours=1)), tie_break="batch_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_default_ranges(spark):
    end = F.lit(T0 + timedelta(days=2))
    logs = spark.createDataFrame([(1, T0 + timedelta(hours=47, minutes=30), "s"), (2, T0 + timedelta(hours=46), "s")], "event_id long, event_time timestamp, service string")
    assert [r.event_id for r in read.search_logs(logs, None, end).collect()] == [1]
    reports = spark.createDataFrame([("1", T0 + timedelta(hours=30), "s"), ("2", T0, "s")], "event_id string, ts timestamp, service string")
    assert [r.event_id for r in read.list_anomalies(reports, None, end).collect()] == ["1"]
