"""Texts and batches that are used several times are computed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import FOLDER
from logtide.catalog import context as c
from logtide.functions import pii
from logtide.sources.writers import latest_rows, upsert


def test_nested_texts_are_redacted_once(spark):
    """One pass for the list and one for the map: the counts take no other."""
    plan = c.scrubbed_nested(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[CC REDACTED]") == 2


def test_nested_lists_maps_and_missing_values(spark):
    rows = spark.createDataFrame(
        [(1, [("a@b.org c@d.org", 1), (None, 2)], {"k": "10.0.0.1", "l": None}), (2, None, None), (3, [], {})],
        "id long, l array<struct<t string, n int>>, m map<string, string>")
    got = {r.id: r for r in pii.scrub_nested(rows, {"l": (["t"], ["n"])}, ["m"], "found").collect()}
    assert [tuple(x) for x in got[1].l] == [("[EMAIL REDACTED] [EMAIL REDACTED]", 1), (None, 2)]
    assert got[1].m == {"k": "[IPv4 REDACTED]", "l": None}
    assert [got[i].found for i in (1, 2, 3)] == [3, 0, 0] and got[2].l is None and got[2].m is None and got[3].m == {}


def test_an_upsert_computes_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    def batch(seq):
        rows = spark.sparkContext.parallelize([(k, k % 2, seq) for k in range(20)], 2).map(counted)
        return spark.createDataFrame(rows, "k long, part long, seq long")

    for seq in range(2):
        upsert(batch(seq), f"{tmp_path}/table", ["k"], ["seq"], "part")
    assert seen.value == 40
    assert {(r.k, r.seq) for r in spark.read.parquet(f"{tmp_path}/table").collect()} == {(k, 1) for k in range(20)}


def test_equals_are_told_apart_by_their_text(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (None, 1, "x"), (2, None, "y")], "k long, seq long, v string")
    assert {(r.k, r.v) for r in latest_rows(rows, ["k"], ["seq"]).collect()} == {(1, "b"), (None, "x"), (2, "y")}
    assert latest_rows(rows.withColumn("w.x", F.lit(1)), ["k"], ["seq"]).columns == ["k", "seq", "v", "w.x"]
