from __future__ import annotations

import random

import pytest
import xxhash

from logtide.llm.components import connected_components
from logtide.llm.simhash import close_pairs, fingerprint, keep_one_of_each, near_duplicates, simhash_report


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def close(a, b, threshold=3):
    return (a ^ b).bit_count() <= threshold


@pytest.mark.parametrize("text", ["", None, "One", "One TWO", "a b c", "ÀB àb x y z", "a\x0bb\x0cc\td\re f g", "to be or not " * 500])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_all_pairs_within_the_threshold(spark, threshold):
    draw = random.Random(threshold)
    values = set()
    for _ in range(40):
        base = draw.getrandbits(64)
        values.add(base)
        for _ in range(8):
            near = base
            for bit in draw.sample(range(64), draw.randint(1, threshold + 1)):
                near ^= 1 << bit
            values.add(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted(r)) for r in close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), threshold).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and close(a & mask, b & mask, threshold)}


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(300, 300), (400, 399), (399, 400), (None, 1)]
    edges += [(draw.randint(500, 580), draw.randint(500, 580)) for _ in range(50)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_report_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(rows)
    expected = roots(ids, [(a, b) for a in ids for b in ids if a < b and close(rows[a], rows[b])])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_report(docs).collect()}
    assert got == {i: (f"{rows[i]:016x}", expected[i]) for i in ids}


def test_edge_rows_and_stage(make_docs):
    text = "some words that make a text of a fair length for hashing"
    rows = [(5, None), (3, ""), (9, text), (7, text), (7, text), (None, "alone without an id"), (None, "alone without an id"), (8, "other words here now")]
    docs = make_docs(rows, fp="x", component_id="y")
    got = sorted(((r.doc_id or 0), r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(0, None), (0, None), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 7)]
    kept = keep_one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 8]
    assert near_duplicates(docs.limit(0)).collect() == [] and keep_one_of_each(docs.limit(0)).collect() == []
