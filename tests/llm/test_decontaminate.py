from __future__ import annotations

import hashlib
import random
import re

import pytest

from logtide.llm.decontaminate import WINDOW, decontamination_report, drop_contaminated, hashed, split_words, winnowed, word_table


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(WINDOW, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).add(item)
    out = {}
    for doc_id, text in docs:
        words, hit, named = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k:k + size])) in windows:
                    hit.update(range(k, k + size))
                    named |= windows[w]
        names = sorted(str(i) for i in named if i is not None)
        out[doc_id] = (len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def result(docs, items):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination_report(docs, items).collect()}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("seed,letters", [(1, 3), (2, 8), (3, 2)])
def test_against_every_window(spark, make_docs, seed, letters):
    draw = random.Random(seed)
    vocabulary = [c + d for c in "abcdé12"[:letters] for d in "xyz"]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(draw.randint(8, 40)))) for i in range(12)] + [(50, "ax ax ay az"), (51, "ax ax ay az"), (52, ""), (53, None)]
    docs = []
    for i in range(50):
        words = some(draw.randint(0, 60))
        for _ in range(draw.randint(0, 2)):
            part = draw.choice(items)[1] or ""
            part = part.split()
            a = draw.randint(0, max(0, len(part) - 1))
            words[draw.randint(0, len(words)):0] = part[a:a + draw.randint(5, 30)]
        docs.append((i, draw.choice([" ", "-", ". "]).join(w.upper() if draw.random() < 0.1 else w for w in words)))
    assert result(make_docs(docs).repartition(4), bench(spark, items)) == brute(docs, items)


def test_every_shared_span_has_a_shared_gram():
    draw = random.Random(9)
    for _ in range(200):
        span = [bytes([draw.choice(b"abc")]) for _ in range(WINDOW)]
        table = word_table()
        sides = []
        for _ in range(2):
            around = [[bytes([draw.choice(b"abc")]) for _ in range(draw.randint(0, 8))] for _ in range(2)]
            at, grams = winnowed(hashed(around[0] + span + around[1], table))
            sides.append({(int(p) - len(around[0]), int(g)) for p, g in zip(at, grams) if len(around[0]) <= p <= len(around[0]) + 5})
        assert sides[0] & sides[1]


def test_edge_rows_and_stage(spark, make_docs):
    phrase = "one two three four five six seven eight nine ten eleven"
    docs = make_docs([(1, None), (2, ""), (3, "x " * 3_000 + phrase.upper()), (4, "one two three four five six seven eight nine"),
                      (5, phrase), (5, phrase), (None, "y " + phrase), (5, "other text"), (5, "other text")],
                     h1="a", size="b", bad_id="c", bad_version="d", version="e", id="f", row="g")
    items = bench(spark, [(7, phrase), (7, phrase), (None, phrase), (8, "!!")])
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontamination_report(docs, items).collect())
    assert got == [(0, 12, 11, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 3_011, 11, 1), (4, 9, 0, 0), (5, 2, 0, 0), (5, 2, 0, 0), (5, 11, 11, 1), (5, 11, 11, 1)]
    kept = drop_contaminated(docs, items)
    assert kept.schema == docs.schema and sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (1, None), (2, ""), (4, "one two three four five six seven eight nine"), (5, "other text"), (5, "other text")]
    assert result(docs.limit(0), items) == {}
    assert all(r[1] == 0 for r in result(docs, items.limit(0)).values())


def test_words():
    for text in ("Ab-c1é  X_y", "", "--", "日本 a\u00a0b", "x" * 300_000 + " Y"):
        assert [w.decode() for w in split_words(text.encode())] == words_of(text)
