"""Hand-computed cases."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtide.functions import pii
from logtide.functions.scalars import number_text, rounded_text
from logtide.functions.timestamps import event_time
from logtide.operators import baseline as b
from logtide.operators import detect as d
from logtide.operators import events as ev
from logtide.operators import monitor as m
from logtide.operators import parse as p
from logtide.operators import reports as rp
from logtide.operators import windows as w
from logtide.operators.limiter import rate_limit
from logtide.operators.suppress import suppress
from logtide.settings import LimiterSettings, WindowSettings

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def samples(spark, values, metric="m", service="s", step=60):
    rows = [(service, metric, at(i * step), float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "service string, metric string, ts timestamp, value double")


def last_state(spark, values):
    return b.latest_baseline(b.baseline_history(samples(spark, values))).first()


@pytest.mark.parametrize("values, ewma", [([100, 10], 91.0), ([0.10, 0.20], 0.11), ([5], 5.0)])
def test_ewma(spark, values, ewma):
    assert last_state(spark, values).ewma == pytest.approx(ewma)


def test_ewma_deviation(spark):
    assert last_state(spark, [1, 0]).std_dev == pytest.approx(math.sqrt(0.09))
    assert last_state(spark, [50] * 10).std_dev == 0.0


def test_mean(spark):
    state = last_state(spark, [10, 20, 30, 40, 50])
    assert (state["mean"], state.sample_count) == (30.0, 5)


@pytest.mark.parametrize("hours, learning", [(0, True), (23.99, True), (24, False), (25, False)])
def test_cold_start(spark, hours, learning):
    row = spark.createDataFrame([(at(0), at(hours * 3600))], "seen timestamp, now timestamp").select(
        b.is_learning(F.col("now"), F.col("seen")).alias("x")).first()
    assert row.x is learning


def test_z_score(spark):
    row = spark.range(1).select(d.z_score(F.lit(600.0), F.lit(50.0), F.lit(5.0)).alias("z"),
                                d.z_score(F.lit(6.0), F.lit(5.0), F.lit(0.0)).alias("flat")).first()
    assert (row.z, row.flat) == (110.0, 0.0)


@pytest.mark.parametrize("learning, z, tier2, reason", [
    (True, 110.0, True, "learning"), (False, 110.0, False, "zscore_critical"), (False, 4.0, True, "both_tiers"),
    (False, 4.0, False, "none"), (False, 3.0, True, "none"), (False, 5.0, True, "both_tiers")])
def test_verdict(spark, learning, z, tier2, reason):
    df = spark.createDataFrame([(learning, z, tier2)], "learning boolean, max_z double, tier2_fired boolean")
    row = d.verdict(df).first()
    assert row.verdict_reason == reason
    assert row.is_anomaly is (reason in ("zscore_critical", "both_tiers"))


def alerts(spark, rows):
    return spark.createDataFrame([(i, s, at(t)) for i, (s, t) in enumerate(rows)],
                                 "event_id bigint, service string, ts timestamp")


def reasons(spark, rows):
    out = suppress(alerts(spark, rows)).orderBy("event_id").collect()
    return [r.reason for r in out], out


def test_five_services_are_no_storm(spark):
    got, _ = reasons(spark, [(f"s{i}", i) for i in range(5)])
    assert got == ["allowed"] * 5


def test_sixth_service_is_a_storm(spark):
    got, rows = reasons(spark, [(f"s{i}", i) for i in range(7)])
    assert got == ["allowed"] * 5 + ["storm", "storm_active"]
    assert len(rows[5].storm_services) == 6


def test_cooldown_goes_before_storm(spark):
    got, _ = reasons(spark, [(f"s{i}", i) for i in range(6)] + [("s0", 10), ("s9", 11)])
    assert got[6:] == ["cooldown", "storm_active"]


def test_cooldown_is_not_extended(spark):
    got, _ = reasons(spark, [("a", 0), ("a", 599), ("a", 600), ("a", 1199), ("a", 1200)])
    assert got == ["allowed", "cooldown", "allowed", "cooldown", "allowed"]


def test_storm_chain(spark):
    """Six services jump at once: one system-wide event that lists all six."""
    rows = []
    for i in range(6):
        flat = [0.01, 0.012] * 20
        rows += [(f"s{i}", at(k * 3600), x) for k, x in enumerate(flat)]
        rows.append((f"s{i}", at(40 * 3600 + i), 0.5))
    features = spark.createDataFrame(rows, "service string, ts timestamp, error_rate double")
    detected = d.detect(features, metrics=("error_rate",)).filter(F.col("ts") >= F.lit(at(40 * 3600)))
    out = ev.emit_events(detected).filter("service = 'system'").collect()
    assert len(out) == 1
    assert (out[0].severity, out[0].anomaly_type, len(out[0].correlated_services)) == ("P1", "system_wide_incident", 6)
    assert out[0].observed == {}


def limited(spark, times, **kw):
    rows = spark.createDataFrame([(i, "s", at(t)) for i, t in enumerate(times)],
                                 "event_id bigint, service string, ts timestamp")
    return [r.allowed for r in rate_limit(rows, LimiterSettings(**kw)).orderBy("event_id").collect()]


def test_limiter_slides(spark):
    assert limited(spark, [0] * 5 + [1800] * 5 + [3601])[-1] is True


def test_limiter_counts_allowed_only(spark):
    assert limited(spark, [0] * 3 + [3601] * 6, limit=5) == [True] * 8 + [False]


def test_limiter_bounds(spark):
    assert limited(spark, [0, 3600], limit=1) == [True, False]
    assert limited(spark, [0, 3600], limit=1, left_open=True) == [True, True]


@pytest.mark.parametrize("text, count", [
    ("mail john+tag@example.org", 1), ("by @johndoe", 0), ("4111111111111111", 1), ("4111-1111-1111-1111", 1),
    ("4111 1111 1111 1111", 1), ("5500000000000004", 1), ("340000000000009", 1), ("3400 000000 00009", 1),
    ("6011000000000004", 1), ("555-867-5309", 1), ("(800) 123-4567", 1), ("415.555.0100", 1),
    ("Port 8080 returned 404 after 200ms", 0), ("Version 2.3.1 is out", 0), ("host 192.168.1.10 down", 1),
    ("2001:db8:85a3:0:0:8a2e:370:7334", 1), ("loop ::1 here", 1), ("a@b.co and 10.0.0.1", 2)])
def test_redaction(spark, text, count):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(pii.scrub_text(F.col("t")).alias("x"), pii.scrub_count(F.col("t")).alias("n")).first()
    assert row.n == count
    assert row.x.count("REDACTED]") == count
    staged = pii.scrub_column(df, "t", "x", "n").first()
    assert (staged.x, staged.n) == (row.x, row.n)


def test_guards_never_hide_a_match(spark):
    texts = ["4111111111111111", "347 1234 1234 1234", "a@b.co", "+1 555 123 4567", "1.2.3.4", "::1", "fe80::", "1:2:3:4:5:6:7:8"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, (pattern, _) in pii.PATTERNS.items():
        wrong = df.filter(F.col("t").rlike(pattern) & ~F.col("t").rlike(pii.GUARDS[name])).count()
        assert wrong == 0, name


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 99, 100, 101, 300):
        logs = spark.range(n).select(
            F.lit("s").alias("service"), F.lit(at(0)).alias("event_time"), F.lit("INFO").alias("level"),
            F.lit("").alias("env"), (F.col("id") * 3).alias("latency_ms"), F.lit("m").alias("message"))
        row = w.service_windows(logs).first()
        for q in (50, 95, 99):
            assert row[f"p{q}_latency_ms"] == 3 * (math.ceil(q / 100.0 * n) - 1)


def test_window_without_latency(spark):
    logs = spark.createDataFrame([("s", at(0), "ERROR", "", None, "x" * 300), ("s", at(1), "ERROR", "prod", None, " ")],
                                 "service string, event_time timestamp, level string, env string, latency_ms bigint, message string")
    row = w.service_windows(logs).first()
    assert (row.p50_latency_ms, row.avg_latency_ms, row.error_rate, row.env) == (None, None, 1.0, "prod")
    assert [(e.message, e["count"]) for e in row.top_errors] == [("x" * 200, 1)]


def test_late_boundary(spark):
    """A window ends at 60 s; with 30 s + 30 s it is closed once an event of 120 s was seen."""
    rows = [(0, at(119.9)), (1, at(59)), (2, at(120)), (3, at(59)), (4, at(60))]
    df = spark.createDataFrame(rows, "seq bigint, event_time timestamp")
    got = w.mark_late(df, "seq", WindowSettings(), chunk_rows=2).orderBy("seq").collect()
    assert [r.is_late for r in got] == [False, False, False, True, False]


@pytest.mark.parametrize("text, ms", [
    ("1704067200000", 1704067200000), ("1704067200", 1704067200000), ("1704067200.5", 1704067200500),
    ("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T05:30:00+05:30", 1704067200000),
    ("2024-01-01 00:00:00,123", 1704067200123), ("2024-01-01 00:00:00.123 UTC", 1704067200123),
    ("12:30", 1), ("yesterday", 1), (" ", 1), (None, 1), ("1.2.3", 1)])
def test_timestamps(spark, text, ms):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.unix_millis(event_time(F.col("t"), F.timestamp_millis(F.lit(1)))).alias("x")).first()
    assert got.x == ms


def test_parse_messages(spark):
    texts = ["", None, "null", "[1]", "5", '{"level":"warn","latency_ms":"12","http":{"duration_ms":7.9}}', '{"a":', '{"error":{"type":"E"}}']
    df = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("timestamp", F.timestamp_millis(F.lit(1)))
    errors = [r.parse_error for r in p.parse_messages(df).collect()]
    assert errors == ["empty message", "empty message", "not an object", "not an object", "not an object", None, "malformed json", None]
    strict = [r.parse_error for r in p.parse_messages(df, strict_types=True).collect()]
    assert strict[-1] == "unexpected nested value"
    rows = p.normalise(p.parsed_records(p.parse_messages(df))).collect()
    assert [(r.level, r.latency_ms, r.error) for r in rows] == [("WARNING", 7, ""), ("UNKNOWN", None, '{"type":"E"}')]


def test_number_texts(spark):
    values = [0.5, 100.0, 1e-05, 0.00012, 12345678.5, 1e16, 0.0, -0.001]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [repr(x) for x in values]
    halves = spark.createDataFrame([(12.5,), (13.5,), (-0.3,), (-12.5,)], "x double")
    assert [r[0] for r in halves.select(rounded_text(F.col("x"))).collect()] == ["12", "14", "-0", "-12"]


def test_primary_metric_ties_go_to_the_first(spark):
    df = spark.sql("""select map('a', 20D, 'b', 0D) as o, map('a', named_struct('ewma', 10D), 'b', named_struct('ewma', 5D)) as b""")
    best = df.select(rp.primary_metric(F.col("o"), F.col("b")).alias("x")).first().x
    assert (best.metric, best.pct) == ("a", 100.0)


def test_counter_reset(spark):
    df = spark.createDataFrame([("c", at(0), 5.0), ("c", at(60), 9.0), ("c", at(120), 2.0), ("c", at(600), 3.0)],
                               "c string, ts timestamp, value double")
    got = [r.increase for r in m.increase(df, ("c",), 300).orderBy("ts").collect()]
    assert got == [0.0, 4.0, 6.0, 1.0]


def test_quantile_interpolates(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, inf, 4.0), (2, 1.0, 0.0), (2, inf, 3.0), (3, 1.0, 0.0), (3, inf, 0.0)],
                               "ts int, le double, value double")
    got = {r.ts: r.quantile for r in m.histogram_quantile(df, 0.75).collect()}
    assert got == {1: 1.5, 2: 1.0}
