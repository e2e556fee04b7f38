"""Newest rows of other services: storms, busy services, ties."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logtide.operators.enrich import correlated_anomalies

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id bigint, service string, ts timestamp"


def expected(rows, events, radius, limit):
    out = set()
    for i, service, t in events:
        others = sorted(((x, j) for j, s, x in rows if s != service and abs(x - t) <= radius), reverse=True)[:limit]
        out |= {(i, rank + 1, j) for rank, (_, j) in enumerate(others)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, s, T0 + timedelta(seconds=t)) for i, s, t in rows], SCHEMA)


@pytest.mark.parametrize("seed,busy,limit", [(1, 0.3, 20), (2, 0.97, 3), (3, 1.0, 5), (4, 0.0, 1)])
def test_against_all_pairs(spark, seed, busy, limit):
    draw = random.Random(seed)
    rows = [(i, "s0" if draw.random() < busy else draw.choice(["s1", "s2", "s3", None]), draw.randrange(2_000)) for i in range(400)]
    got = correlated_anomalies(frame(spark, rows), radius=120, limit=limit, fields=["event_id"])
    assert {(r.event_id, r.rank, r.other_event_id) for r in got.collect()} == expected(rows, rows, 120, limit)


def test_other_tables_of_events_and_anomalies(spark):
    draw = random.Random(7)
    rows = [(i, draw.choice("abc"), draw.randrange(900)) for i in range(150)]
    events = [(1_000 + i, draw.choice("abcd"), draw.randrange(-300, 1_200)) for i in range(60)]
    got = correlated_anomalies(frame(spark, events), frame(spark, rows), radius=100, limit=4, fields=["event_id"])
    assert {(r.event_id, r.rank, r.other_event_id) for r in got.collect()} == expected(rows, events, 100, 4)


def test_a_storm_is_no_product(spark):
    """A thousand services at once: every event gets its few rows, and no more are looked up."""
    rows = [(i, f"s{i}", i % 7) for i in range(1_000)]
    got = correlated_anomalies(frame(spark, rows), radius=120, limit=20, fields=["event_id"])
    assert got.count() == 1_000 * 20
    plan = got.select("event_id", "rank", F.col("other_event_id"))
    plan.write.format("noop").mode("overwrite").save()
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()
    few = got.filter("event_id < 30").collect()
    assert {(r.event_id, r.rank, r.other_event_id) for r in few} == expected(rows, rows[:30], 120, 20)


def test_intermediates_can_be_cleared(spark):
    from pathlib import Path

    from logtide import session

    kept, session._SCRATCH[:] = list(session._SCRATCH), []
    got = correlated_anomalies(frame(spark, [(1, "a", 0), (2, "b", 1)]), fields=["event_id"])
    assert got.count() == 2
    paths = list(session._SCRATCH)
    assert paths and all(Path(p.removeprefix("file:")).exists() for p in paths)
    assert session.clear_scratch(spark) == len(paths) and not any(Path(p.removeprefix("file:")).exists() for p in paths)
    session._SCRATCH[:] = kept
