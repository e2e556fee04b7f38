"""Newest rows of other services: the work does not grow with the range, and parts that are cut by order."""

from __future__ import annotations

import random

import pytest
from test_others import expected, frame

from logtide.operators.enrich import correlated_anomalies


@pytest.mark.parametrize("size,busy,limit", [(1, 0.5, 4), (3, 0.9, 20), (50, 0.0, 2)])
def test_batches_and_parts(spark, size, busy, limit):
    """Arrow batches of a few rows, parts that share a second, null services, events before and after all anomalies."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        draw = random.Random(size)
        rows = [(i, "s0" if draw.random() < busy else draw.choice(["s1", "s2", None]), draw.choice([5, 5, draw.randrange(300)])) for i in range(120)]
        events = [(500 + i, draw.choice(["s0", "s1", "new", None]), draw.randrange(-400, 900)) for i in range(80)]
        got = correlated_anomalies(frame(spark, events), frame(spark, rows), radius=200, limit=limit, fields=["event_id"])
        assert sorted((r.event_id, r.rank, r.other_event_id) for r in got.collect()) == sorted(expected(rows, events, 200, limit))
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def shuffled_rows(spark, run):
    """Rows that the stages of `run` put into shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for i, n in stages().items() if i not in before)


def test_a_wide_range_costs_no_more(spark):
    """Ten times the range, nearly the same rows moved: none for each piece of time in it."""
    rows = [(i, f"s{i % 3}", i * 10) for i in range(600)]
    events = frame(spark, rows)

    def moved(radius):
        return shuffled_rows(spark, lambda: correlated_anomalies(events, radius=radius, limit=4, fields=["event_id"])
                             .write.format("noop").mode("overwrite").save())

    narrow, wide = moved(1_000), moved(10_000)
    assert wide < 1.2 * narrow and wide < 12 * len(rows)
