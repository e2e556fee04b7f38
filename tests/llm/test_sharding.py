from __future__ import annotations

import random
import zlib

import pytest

from logtide.llm import sharding
from logtide.llm.sharding import assign_shards, shard_report, write_shards


def expected(rows, shards):
    """Records in order of the keys; a record lies where its first byte does."""
    records = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, at, out = sum(r[3] for r in records), 0, []
    for r in records:
        out.append((r[1] if r[0] else None, r[3], r[2], min(shards - 1, at * shards // total)))
        at += r[3]
    slots, final = {}, []
    for r in out:
        final.append((*r, slots.get(r[3], 0)))
        slots[r[3]] = slots.get(r[3], 0) + 1
    return final


def order(rows):
    return sorted(tuple(x) for x in rows) if all(x[0] is not None for x in rows) else sorted((x[0] is not None, x[0] or 0, *x[1:]) for x in rows)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_against_sorted_records(make_docs, shards):
    draw = random.Random(shards)
    rows = [(draw.choice([7, draw.randint(0, 500)]), "é" * draw.choice([0, 3, 40, 900])) for _ in range(300)]
    rows += [(7, "same")] * 100 + [(9, None), (None, "x"), (None, None)]
    got = assign_shards(make_docs(rows, shard="a", tie="b").repartition(5), shards).collect()
    assert order(got) == order(expected(rows, shards))


def test_overfull_ranges_are_subdivided(make_docs, monkeypatch):
    """With hardly any sample the ranges are uneven, and the result is the same."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)
    calls = []
    real = sharding._sample
    monkeypatch.setattr(sharding, "_sample", lambda *a: calls.append(1) or real(*a))
    rows = [(1, "x" * 10)] * 200 + [(i, "y" * i) for i in range(2, 60)]
    got = assign_shards(make_docs(rows), 6).collect()
    assert order(got) == order(expected(rows, 6)) and len(calls) > 1


def test_report_and_laws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_report(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and len(rows) == docs.count()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(24):
        own = [r for r in rows if r.shard == shard]
        assert abs(sum(r["size"] for r in own) - total / 24) <= largest
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_edge_tables(make_docs):
    assert assign_shards(make_docs([])).collect() == []
    assert [tuple(r)[3:] for r in assign_shards(make_docs([(1, None)])).collect()] == [(0, 0)]


def test_written_shards(spark, make_docs, tmp_path):
    rows = [(1, "a" * 50)] * 3 + [(i, "b" * i) for i in range(20)] + [(None, None)]
    docs = make_docs(rows, copy="x", size="y")
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("_shard").collect())) == sorted(map(str, docs.collect()))
    places = {(r.shard, r.n) for r in assign_shards(docs, 4).groupBy("shard").count().toDF("shard", "n").collect()}
    assert {(r[0], r[1]) for r in back.groupBy("_shard").count().collect()} == places
