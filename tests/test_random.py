"""Operators against plain loops on random input, with busy keys."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.functions import pii
from logtide.operators import forest
from logtide.operators.chunks import running_count, running_max_before
from logtide.operators.limiter import rate_limit
from logtide.operators.nearest import newest_in_range
from logtide.operators.suppress import cooldown, sliding_services, suppress
from logtide.settings import DetectionSettings, LimiterSettings, SuppressionSettings

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(seed: int, n: int, span: int, services: int = 8):
    """One service makes up about a third of the rows; times collide."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        service = "s0" if rng.random() < 0.33 else f"s{rng.randrange(services)}"
        out.append((i, service, rng.randrange(span)))
    return sorted(out, key=lambda r: (r[2], r[1], r[0]))


def frame(spark, rows):
    return spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows],
                                 "event_id bigint, service string, ts timestamp")


@pytest.mark.parametrize("seed", range(3))
def test_suppress(spark, seed):
    rows = rows_of(seed, 400, 20_000)
    s = SuppressionSettings()
    cooled, recent, storm_until, expected = {}, {}, -1, {}
    for i, service, t in rows:
        if t < cooled.get(service, -1):
            reason = "cooldown"
        elif t < storm_until:
            reason = "storm_active"
        else:
            cooled[service], recent[service] = t + s.cooldown, t
            live = [k for k, x in recent.items() if x > t - s.storm_window]
            reason = "allowed"
            if len(live) > s.storm_threshold:
                reason, storm_until = "storm", t + s.storm_cooldown
        expected[i] = reason
    got = {r.event_id: r.reason for r in suppress(frame(spark, rows), s).collect()}
    assert got == expected


@pytest.mark.parametrize("left_open", [False, True])
def test_limiter(spark, left_open):
    rows = rows_of(7, 600, 30_000)
    s = LimiterSettings(limit=4, window=900, left_open=left_open)
    kept, expected = {}, {}
    for i, service, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = [x for x in kept.get(service, []) if (x > t - s.window if left_open else x >= t - s.window)]
        allowed = len(live) < s.limit
        kept[service] = live + [t] if allowed else live
        expected[i] = (allowed, len(kept[service]))
    got = {r.event_id: (r.allowed, r.current_count) for r in rate_limit(frame(spark, rows), s).collect()}
    assert got == expected


def test_cooldown(spark):
    rows = rows_of(3, 500, 50_000)
    last, expected = {}, {}
    for i, service, t in sorted(rows, key=lambda r: (r[2], r[0])):
        allowed = service not in last or t - last[service] >= 600
        if allowed:
            last[service] = t
        expected[i] = allowed
    got = {r.event_id: r.allowed for r in cooldown(frame(spark, rows), 600, tie_break=["event_id"]).collect()}
    assert got == expected


def test_sliding_services(spark):
    rows = rows_of(5, 300, 5_000)
    got = {r.event_id: r.services for r in sliding_services(frame(spark, rows), 60).collect()}
    for i, _, t in rows:
        assert got[i] == len({s for _, s, x in rows if t - 60 < x <= t})


@pytest.mark.parametrize("open_past", [False, True])
def test_newest_in_range(spark, open_past):
    rows = rows_of(11, 800, 4_000)
    queries = rows_of(12, 60, 4_000)
    lower = None if open_past else F.timestamp_micros(F.unix_micros("ts") - 300_000_000)
    data = frame(spark, rows).withColumnRenamed("event_id", "row_id")
    got = newest_in_range(frame(spark, queries), data, "service", "event_id", lower, F.col("ts"), "ts", "row_id",
                          ["row_id"], 5, bucket_seconds=100).collect()
    for q, service, t in queries:
        want = sorted([(x, i) for i, s, x in rows if s == service and x <= t and (open_past or x >= t - 300)], reverse=True)[:5]
        assert [r.row_id for r in sorted(got, key=lambda r: r["rank"]) if r.event_id == q] == [i for _, i in want]


def test_chunked_running_values(spark):
    rng = random.Random(1)
    values = [(k, n, rng.randrange(1000)) for k in ("a", "b") for n in range(300)]
    df = spark.createDataFrame(values, "k string, n int, x int")
    largest = running_max_before(df, ["k"], ["n"], F.floor(F.col("n") / 7), F.col("x"), "m")
    counted = running_count(df, ["k"], ["n"], F.floor(F.col("n") / 7), F.col("x") > 500, "c")
    best, count = {}, {}
    expected = {}
    for k, n, x in values:
        count[k] = count.get(k, 0) + (x > 500)
        expected[k, n] = (best.get(k), count[k])
        best[k] = max(best.get(k, x), x)
    got = {(r.k, r.n): r.m for r in largest.collect()}
    got_counts = {(r.k, r.n): r.c for r in counted.collect()}
    assert got == {key: v[0] for key, v in expected.items()}
    assert got_counts == {key: v[1] for key, v in expected.items()}


def test_forest_prefers_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 5)), np.full((1, 5), 12.0)])
    model = forest.grow_forest(x, 100, 256, 42)
    again = forest.grow_forest(x, 100, 256, 42)
    assert all(np.array_equal(a, b) for a, b in zip(model, again))
    path = forest.mean_path_lengths(x, 100, 256, *model)
    score = -np.power(2.0, -path / float(forest.average_path(256)))
    assert score.argmin() == 300
    assert (score > -1).all() and (score < 0).all()


def test_forest_sizes_add_up():
    x = np.random.default_rng(1).normal(0, 1, (50, 3))
    feature, _, size = forest.grow_forest(x, 10, 50, 2)
    nodes = len(feature) // 10
    for tree in range(10):
        f, s = feature[tree * nodes:(tree + 1) * nodes], size[tree * nodes:(tree + 1) * nodes]
        assert s[0] == 50
        for i in np.flatnonzero(f >= 0):
            assert s[i] == s[2 * i + 1] + s[2 * i + 2]


def test_trees_are_functions_of_their_data_and_number():
    """More trees leave the first ones as they are; another seed or model gives others."""
    x = np.random.default_rng(5).normal(0, 1, (300, 4))
    few, many = forest.grow_forest(x, 3, 64, 7, 1_704_067_200_000_000), forest.grow_forest(x, 9, 64, 7, 1_704_067_200_000_000)
    assert all(np.array_equal(a, b[:len(a)]) for a, b in zip(few, many))
    assert any(not np.array_equal(a, b) for a, b in zip(few, forest.grow_forest(x, 3, 64, 8, 1_704_067_200_000_000)))
    assert any(not np.array_equal(a, b) for a, b in zip(few, forest.grow_forest(x, 3, 64, 7, 1_704_067_200_000_001)))


def test_draws_are_even():
    got = forest.draws(42, 1, forest.SAMPLE, np.arange(100)[:, None], np.arange(1_000))
    assert len(np.unique(got)) > 99_000 and abs(got.mean() / 2**32 - 0.5) < 0.005
    assert np.bincount(got.ravel() >> 28, minlength=16).min() > 5_900


def test_constant_features_do_not_split():
    feature, _, size = forest.grow_forest(np.ones((20, 5)), 5, 20, 0)
    assert (feature == -1).all() and size.sum() == 100


def test_forest_scores(spark):
    rng = np.random.default_rng(3)
    rows = [("s", T0 + timedelta(hours=i), *map(float, rng.normal(10, 1, 5))) for i in range(200)]
    rows.append(("s", T0 + timedelta(hours=200), 90.0, 90.0, 90.0, 90.0, 90.0))
    df = spark.createDataFrame(rows, "service string, ts timestamp, error_rate double, p99_latency_ms double, "
                                     "avg_latency_ms double, request_volume double, warn_rate double")
    got = forest.score(df, DetectionSettings()).orderBy("ts").collect()
    assert len(got) == 201
    assert [r.model_available for r in got] == [False] * 99 + [True] * 102
    assert got[-1].tier2_fired and got[-1].forest_score == min(r.forest_score for r in got)
    # About five percent of the training rows lie below the offset.
    assert sum(r.forest_score < 0 for r in got[:100]) <= 7


def test_redaction_of_random_texts(spark):
    rng = random.Random(9)
    parts = ["4111111111111111", "a@b.co", "555-867-5309", "10.1.2.3", "fe80::1", "plain", "é", "x_", " ", "-", "1.2.3", "::"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import re
    got = df.select("t", pii.scrub_text(F.col("t")).alias("x"), pii.scrub_count(F.col("t")).alias("n")).collect()
    for r in got:
        text, n = r.t, 0
        for pattern, label in pii.PATTERNS.values():
            text, k = re.subn(pattern.replace("(?U)", ""), label, text)
            n += k
        assert (r.x, r.n) == (text, n), r.t
