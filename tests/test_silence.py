from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from logtide.plans import read

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_silences_over_midnight(spark):
    rng = random.Random(2)
    alerts = [(i, rng.choice("ab"), rng.randrange(5 * 1440)) for i in range(200)]
    asked = [(rng.choice("ab"), rng.randrange(5 * 1440), rng.choice([5, 60, 700, 1440, 1441, 0])) for _ in range(12)]
    a = spark.createDataFrame([(i, s, T0 + timedelta(minutes=t)) for i, s, t in alerts], "event_id int, service string, ts timestamp")
    q = spark.createDataFrame([(s, T0 + timedelta(minutes=t), m) for s, t, m in asked], "service string, ts timestamp, minutes int")
    got = {r.event_id: r.silenced for r in read.mark_silenced(a, read.silence(q)).collect()}
    for i, s, t in alerts:
        assert got[i] == any(x == s and 1 <= m <= 1440 and f <= t < f + m for x, f, m in asked)
    kept = read.drop_silenced(a, read.silence(q))
    assert kept.count() == sum(not v for v in got.values())
    assert read.active_silences(read.silence(q), F.lit(T0)).count() >= 0
