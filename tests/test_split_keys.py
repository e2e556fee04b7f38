"""Keys that are never silent, folded in several tasks: equal to plain loops."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from logtide.operators.baseline import baseline_history
from logtide.operators.limiter import rate_limit
from logtide.operators.speculate import Rounds
from logtide.operators.suppress import NEVER, cooldown, orbit_map, suppress
from logtide.settings import BaselineSettings, LimiterSettings, SuppressionSettings

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows],
                                 "event_id bigint, service string, ts timestamp").repartition(5)


def busy_rows(seed: int, n: int, span: int, services: int = 8):
    """No silence anywhere; a third of the rows are of one service, and a few have none."""
    rng = random.Random(seed)
    names = [None if rng.random() < 0.02 else "s0" if rng.random() < 0.33 else f"s{rng.randrange(services)}" for _ in range(n)]
    times = [rng.randrange(span) for _ in range(n)]
    return sorted(zip(range(n), names, times), key=lambda r: (r[2], r[1] is not None, r[1] or "", r[0]))


def storm_loop(rows, s, clears=()):
    """{id: (reason, members)} of a serial fold."""
    cooled, recent, storm_until, out = {}, {}, NEVER, {}
    both = sorted([(t, True, service is not None, service or "", i, False) for i, service, t in rows]
                  + [(t, True, True, "", -1, True) for t in clears], key=lambda r: (r[0], r[2], r[3], not r[5]))
    for t, _, known, service, i, clear in both:
        service = service if known else None
        recent = {k: x for k, x in recent.items() if x > t - s.storm_window}
        if clear:
            recent, storm_until = {}, NEVER
            continue
        if t < cooled.get(service, NEVER):
            reason = "cooldown"
        elif t < storm_until:
            reason = "storm_active"
        else:
            cooled[service], recent[service], reason = t + s.cooldown, t, "allowed"
            if len(recent) > s.storm_threshold:
                reason, storm_until = "storm", t + s.storm_cooldown
        out[i] = (reason, frozenset(recent))
    return out


@pytest.mark.parametrize("seed,settings", [
    (1, SuppressionSettings()),
    (2, SuppressionSettings(cooldown=70, storm_window=200, storm_threshold=3, storm_cooldown=400)),
    (3, SuppressionSettings(cooldown=900, storm_window=30, storm_threshold=2, storm_cooldown=50))])
def test_one_island_over_all_history(spark, seed, settings):
    rows = busy_rows(seed, 4_000, 40_000)
    assert max(b[2] - a[2] for a, b in zip(rows, rows[1:])) < settings.memory
    report = Rounds()
    decided = suppress(frame(spark, rows), settings, chunk_rows=300, report=report)
    got = {r.event_id: (r.reason, frozenset(r.storm_services)) for r in decided.collect()}
    assert got == storm_loop(rows, settings)
    assert report.chunks > 8 and report.rounds >= 1


def test_clears_inside_chunks(spark):
    rows, s = busy_rows(4, 2_000, 20_000), SuppressionSettings(cooldown=60, storm_window=120, storm_threshold=3, storm_cooldown=600)
    clears = [1_000, 5_555, 12_345, 19_000]
    times = spark.createDataFrame([(T0 + timedelta(seconds=t),) for t in clears], "ts timestamp")
    got = {r.event_id: (r.reason, frozenset(r.storm_services)) for r in suppress(frame(spark, rows), s, clears=times, chunk_rows=200).collect()}
    assert got == storm_loop(rows, s, clears)


def test_phase_that_never_fades_ends_serially(spark):
    """One alert a minute and a cooldown of 7 minutes: a chunk with another start never agrees, so rounds are bounded."""
    rows, s, report = [(i, "a", 60 * i) for i in range(3_000)], SuppressionSettings(cooldown=420), Rounds()
    got = {r.event_id: r.allowed for r in suppress(frame(spark, rows), s, chunk_rows=150, report=report).collect()}
    assert got == {i: i % 7 == 0 for i in range(3_000)}
    assert report.serial and report.rounds == 6


def test_islands_and_chunks_together(spark):
    rows = [(i, f"s{i % 3}", t) for i, t in enumerate([*range(0, 9_000, 10), *range(50_000, 50_100, 10), *range(90_000, 99_000, 7)])]
    got = {r.event_id: r.reason for r in suppress(frame(spark, rows), SuppressionSettings(), chunk_rows=100).collect()}
    assert got == {i: reason for i, (reason, _) in storm_loop(rows, SuppressionSettings()).items()}


@pytest.mark.parametrize("step,seconds", [(60, 600), (60, 420), (7, 100), (1, 3)])
def test_cooldown_of_a_service_that_always_alerts(spark, step, seconds):
    rows = [(i, "a", step * i) for i in range(3_000)] + [(3_000 + i, "b", t) for i, t in enumerate([0, 5, 10_000])]
    marked = cooldown(frame(spark, rows), seconds, chunk_rows=100)
    last, expected = {}, {}
    for i, service, t in rows:
        expected[i] = t - last.get(service, NEVER) >= seconds
        last[service] = t if expected[i] else last[service]
    assert {r.event_id: r.allowed for r in marked.collect()} == expected


def test_cooldown_of_random_times_ties_and_null_keys(spark):
    rows = busy_rows(6, 3_000, 9_000)
    marked = cooldown(frame(spark, rows), 50, tie_break=["event_id"], chunk_rows=120)
    assert marked.columns == ["event_id", "service", "ts", "allowed"]
    last, expected = {}, {}
    for i, service, t in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[i] = t - last.get(service, NEVER) >= 50
        last[service] = t if expected[i] else last[service]
    assert {r.event_id: r.allowed for r in marked.collect()} == expected


def test_orbit_maps_compose():
    rng = np.random.default_rng(1)
    for _ in range(50):
        times, wait = np.unique(rng.integers(0, 400, rng.integers(1, 80))), int(rng.integers(1, 60))
        bounds, ends = orbit_map(times, wait)
        for b in range(-5, 410):
            at, last = b, None
            for t in times.tolist():
                if t >= at:
                    at, last = t + wait, t
            i = int(np.searchsorted(bounds, b))
            assert (int(ends[i]) if i < len(bounds) else b) == at


@pytest.mark.parametrize("left_open,limit,window", [(False, 4, 60), (True, 10, 300), (True, 1, 45)])
def test_contended_key_over_many_tasks(spark, left_open, limit, window):
    rows = busy_rows(8, 4_000, 30_000, services=3)
    s, report = LimiterSettings(limit=limit, window=window, left_open=left_open), Rounds()
    kept, expected = {}, {}
    for i, service, t in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [x for x in kept.get(service, []) if (x > t - window if left_open else x >= t - window)]
        allowed = len(live) < limit
        kept[service] = live + [t] if allowed else live
        expected[i] = (allowed, len(kept[service]))
    got = {r.event_id: (r.allowed, r.current_count) for r in rate_limit(frame(spark, rows), s, chunk_rows=150, report=report).collect()}
    assert got == expected
    assert report.chunks > 8


def baseline_loop(times, values, s):
    count = mean = std = ewma = last = 0
    for t, x in zip(times, values):
        if count and t - last > s.expiry:
            count = 0
        before = (ewma, std) if count else (None, None)
        if not count:
            count, mean, ewma, std = 1, x, x, 0.0
        else:
            variance = (1 - s.alpha) * (std * std + s.alpha * (x - ewma) ** 2)
            ewma, std, count = s.alpha * x + (1 - s.alpha) * ewma, math.sqrt(variance), count + 1
            mean += (x - mean) / count
        last = t
        yield (*before, ewma, std, mean, count)


@pytest.mark.parametrize("expiry,chunk_rows", [(7 * 86_400, 100), (400, 100), (90, 37), (10**9, 1_000)])
def test_baselines_of_long_series(spark, expiry, chunk_rows):
    rng, s = np.random.default_rng(expiry), BaselineSettings(expiry=expiry)
    series = {("a", "m"): (np.cumsum(rng.integers(1, 120, 3_000)), rng.normal(1e6, 3, 3_000)),
              ("a", "k"): (np.arange(0, 60_000, 60), np.full(1_000, 50.0)),
              (None, "m"): (np.append(np.arange(0, 6_000, 60), 10**7), rng.normal(0, 1e-3, 101)),
              ("b", "m"): (np.array([5]), np.array([1.5]))}
    rows = [(i[0], i[1], T0 + timedelta(seconds=int(t)), float(x)) for i, (ts, xs) in series.items() for t, x in zip(ts, xs)]
    frame = spark.createDataFrame(rows, "service string, metric string, ts timestamp, value double").repartition(4)
    got = {}
    for r in baseline_history(frame, s, chunk_rows).collect():
        got.setdefault((r.service, r.metric), []).append(r)
    for key, (ts, xs) in series.items():
        rows = sorted(got.pop(key), key=lambda r: r.ts)
        assert len(rows) == len(ts)
        for r, (e0, s0, e, d, m, n) in zip(rows, baseline_loop(ts.tolist(), xs.tolist(), s)):
            assert r.sample_count == n and (r.prev_ewma is None) == (e0 is None)
            assert r.ewma == pytest.approx(e, rel=1e-12, abs=1e-15) and r["mean"] == pytest.approx(m, rel=1e-11, abs=1e-12)
            assert r.std_dev == pytest.approx(d, rel=1e-7, abs=1e-12)
            if e0 is not None:
                assert r.prev_ewma == pytest.approx(e0, rel=1e-12, abs=1e-15) and r.prev_std == pytest.approx(s0, rel=1e-7, abs=1e-12)
    assert not got
