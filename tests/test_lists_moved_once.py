"""Look-ups near an event move each row and each answer once, however many rows an answer has."""

from __future__ import annotations

from test_newest_of_others import shuffled_rows
from test_others import frame

from logtide.operators import enrich as e


def test_longer_answers_move_no_more_rows(spark):
    rows = [(i, f"s{i % 3}", i * 10) for i in range(600)]
    events, logs = frame(spark, rows), frame(spark, rows).withColumnRenamed("ts", "event_time")

    def moved(limit):
        lists = e.log_samples(events, logs, ["event_id"], before=2_000, after=0, limit=limit, lists=True)
        return shuffled_rows(spark, lambda: e.one_list(lists, "found").write.format("noop").mode("overwrite").save())

    one, many = moved(1), moved(20)
    assert many < 1.5 * one
    got = e.log_samples(events, logs, ["event_id"], before=2_000, after=0, limit=20, lists=True)
    found = {r.service + str(r.event_id): [x.event_id for x in r.found] for r in got.collect()}
    assert found["s2599"] == [599 - 3 * i for i in range(20)] and found["s00"] == [0] and len(found) == 600


def test_lists_of_repeated_ids_are_merged_by_rank(spark):
    lists = spark.createDataFrame([(1, [("a",), ("b",)]), (1, [("c",)]), (2, [("d",)])], "event_id long, found array<struct<v string>>")
    got = {r.event_id: [x.v for x in r.l] for r in e.one_list(lists, "l").collect()}
    assert got == {1: ["a", "c", "b"], 2: ["d"]}
