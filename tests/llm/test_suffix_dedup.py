from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from logtide.llm import suffix_dedup
from logtide.llm.suffix_dedup import cut, merged, suffix_dedup_report


def brute(rows, length):
    """One window at a time, in order of id and position."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(docs, **more):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup_report(docs, **more).collect()}


def passages(seed, n):
    """Texts over few letters, with shared passages, copies, cuts at either side and periodic stretches."""
    draw = random.Random(seed)
    shared = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(20, 260))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            passage = draw.choice(shared)
            if kind < 0.5:
                cut_at = draw.randint(0, len(passage))
                parts.append(passage[cut_at:] if draw.random() < 0.3 else passage[:cut_at] if draw.random() < 0.4 else passage)
            elif kind < 0.6:
                parts.append(draw.choice(["ab", "a", "xyz"]) * draw.randint(1, 90))
            else:
                parts.append("".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 150))))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,length", [(1, 100), (2, 100), (3, 65), (4, 64)])
def test_against_every_window(make_docs, seed, length):
    rows = passages(seed, 60)
    assert result(make_docs(rows).repartition(5), length=length) == brute(rows, length)


def test_frequent_anchors_and_small_pieces(make_docs, monkeypatch):
    """A common stretch shorter than a window in every text, and texts cut into many pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    suffix_dedup._tables.cache_clear()
    draw = random.Random(5)
    common = "a very common stretch of about sixty bytes, but not a hundred"
    rows = [(i, "".join(draw.choice("abcdefghij") for _ in range(700)) + common + "".join(draw.choice("ab") for _ in range(9))) for i in range(40)]
    rows += [(100 + i, rows[i][1][300:] * 2) for i in range(5)]
    found = suffix_dedup._frequent_anchors(
        make_docs(rows).selectExpr("doc_id id", "crc32(text) version", "text"), 100, 32)
    assert len(found)
    assert result(make_docs(rows).repartition(4)) == brute(rows, 100)
    suffix_dedup._tables.cache_clear()


def test_edge_rows(make_docs):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    rows = [(1, None), (2, ""), (3, long), (4, "x" + long), (5, "x" * 5_000), (6, long[:99])]
    assert result(make_docs(rows, spans="a", id="b")) == brute(rows, 100)
    assert result(make_docs([]), length=100) == {}
    twice = suffix_dedup_report(make_docs([(7, long), (7, long), (None, long)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (7, 150), (7, 150)]


def test_cut_merges_spans():
    def outside(raw, spans):
        return cut(raw, *merged(*(np.array([s[k] for s in spans], np.int64) for k in range(2))))

    assert outside(b"0123456789", [(5, 7), (1, 3), (2, 4), (7, 8)]) == (b"0489", 2)
    assert outside(b"0123456789", [(1, 9), (2, 3), (9, 10)]) == (b"0", 1)
    assert outside(b"012", []) == (b"012", 0)
    assert outside(b"012", [(0, 3)]) == (b"", 1)
