from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from logtide.llm.vector_codes import History, compress, compression_report, squared


def plain(rows, rounds=2, entries=64):
    """Full scans in Python integers over (vec_id, vector, label): code, error and label_error of each row, digest of the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(kept[0][1]) // 16)
    kept = [(i, v + [0] * (16 * width - len(v)), c) for i, v, c in kept if len(v) == len(kept[0][1])]
    parts = [[tuple(v[p * width:(p + 1) * width]) for p in range(16)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:entries]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(16):
            own = [[] for _ in books[p]]
            for row in parts:
                own[nearest(p, row[p])[1]].append(row[p])
            moved.append([tuple(sum(c) // len(xs) for c in zip(*xs)) if xs else e for xs, e in zip(own, books[p])])
        books = moved
    found = [[nearest(p, row[p]) for p in range(16)] for row in parts]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, totals[label], digest)
                   for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


def vectors(spark, rows, **extra):
    names = "".join(f", {n} string" for n in extra)
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], f"vec_id long, embedding array<float>, label int{names}")


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def drawn(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (12, width))
    return [(int(i), np.float32(centres[rng.integers(12)] + rng.normal(0, 0.2, width)).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]


@pytest.mark.parametrize("n,width,seed", [(400, 64, 1), (150, 16, 2), (30, 32, 3), (90, 19, 4)])
def test_same_as_full_scans(spark, n, width, seed):
    rows = drawn(n, width, seed)
    assert got(compression_report(vectors(spark, rows))) == plain(rows)


def test_more_rounds_and_fewer_entries(spark):
    rows = drawn(300, 32, 5)
    assert got(compression_report(vectors(spark, rows), rounds=6, entries=7)) == plain(rows, 6, 7)


def test_odd_rows(spark):
    good = drawn(80, 16, 6)
    nan, inf = float("nan"), float("inf")
    rows = [*good, good[0], good[1], good[1], (None, [0.5] * 16, None), (7, [0.5] * 16, None), (200, None, 1), (201, [nan] + [0.0] * 15, 1),
            (202, [0.0] * 15 + [-inf], 2), (203, [None] + [1.0] * 15, 2), (204, [-0.0] * 16, 2), (-5, [1.0] * 15, 0), (-6, [-1000.25] * 16, 1)]
    assert got(compression_report(vectors(spark, rows, code="x", x="y", bound="z", salt="s"))) == plain(rows)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [float(i % 3)] * 16, i % 2) for i in range(200)]
    assert got(compression_report(vectors(spark, rows))) == plain(rows)


def test_empty_and_refused(spark):
    assert compression_report(vectors(spark, [])).collect() == []
    assert compression_report(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(Exception, match="below"):
        compression_report(vectors(spark, [(1, [0.0] * 16, 1), (200, [1e9] * 16, 1)]), entries=1).collect()


def test_bounds_spare_scans(spark):
    """Parts compared with all entries in the last assignment: fewer than there are, and few once the codebooks settle."""
    table, scanned = vectors(spark, drawn(2_000, 64, 8)), {}
    for rounds in (2, 12):
        coded, _ = compress(table, rounds)
        scanned[rounds] = sum(r.scans for r in coded.select("scans").collect())
    assert 0 < scanned[12] < 0.5 * scanned[2] and scanned[2] < 0.8 * 2_000 * 16


def test_net_displacement_keeps_bounds_that_drifts_lose():
    """Entries that move away and come back: the sum of their moves is zero, and no part is scanned again."""
    rng = np.random.default_rng(9)
    start = np.array([[[0, 0], [1000, 0]]] * 16)
    away = start + np.array([[0, 0], [-480, 0]])
    x = rng.integers(-5, 6, (50, 16, 2))
    code, bound, stamp = np.zeros((50, 16), np.uint8), np.zeros((50, 16)), np.full((50, 16), 255, np.uint8)
    error, scans = History([start]).assign(x, code, bound, stamp)
    assert (scans == 16).all()
    error, scans = History([start, away, start]).assign(x, code, bound, stamp)
    assert not scans.any() and (stamp == 0).all() and (error == sum(squared(x[:, p], start[p])[:, 0] for p in range(16))).all()
