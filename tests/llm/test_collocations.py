from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm.collocations import SCALE, collocation_report, collocations, lockstep

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=4, least=30):
    """{(lang, phrase): (a, l, r, n, score)} from all phrases of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, words[i:i + size]] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, words[i:i + size])
                inside[key] = max(inside[key], a)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] < 80 * a:
            score, k = min((SCALE * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out[lang, " ".join(words)] = (a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score)
    return out


def ranked(found, top=2000):
    rows = []
    for lang in {k[0] for k in found}:
        best = sorted(((-v[4], -v[0], p.encode(), v) for (g, p), v in found.items() if g == lang))[:top]
        rows += [(lang, i, p.decode(), *v) for i, (_, _, p, v) in enumerate(best, 1)]
    return sorted(rows)


def texts(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for _ in range(n):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum())
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words))
    return out


def documents(spark, rows, **extra):
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], "text string, lang string" + "".join(f", {k} string" for k in extra))


VOCABULARY = ["the", "The", "of", "New", "york", "a", "a\x01", "é", "日本", "\x0e", " ", "x\xa0y", "#", "ß", "city", "zoo"]


@pytest.mark.parametrize("range_rows", [100_000, 40, 7])
def test_same_as_all_phrases(spark, range_rows):
    rows = [(t, [None, "en", "und", "de"][i % 4]) for i, t in enumerate(texts(range_rows, 250, VOCABULARY))]
    docs = documents(spark, rows, f="1", key="2", parts="3", range="4")
    found = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations(docs, least=5, range_rows=range_rows).collect()}
    assert found == brute(rows, least=5)


def test_small_filter_only_costs_counts(spark):
    rows = [(t, "en") for t in texts(3, 200, VOCABULARY)]
    found = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations(documents(spark, rows), least=4, bits=64).collect()}
    assert found == brute(rows, least=4)


def test_table_and_ranks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocation_report(docs).collect()) == ranked(brute(rows))
    assert sorted(tuple(r) for r in collocation_report(docs, top=3, longest=3, least=10).collect()) == ranked(brute(rows, 3, 10), 3)


def test_null_empty_repeated_and_long(spark):
    assert collocation_report(documents(spark, [])).collect() == []
    assert collocation_report(documents(spark, [(None, None), ("", "en"), (" \t.,", None)])).collect() == []
    rows = [("to be or not " * 20_000, None), *[("one two", "en")] * 31, (None, "en"), ("A B\x85C", "en")]
    assert sorted(tuple(r) for r in collocation_report(documents(spark, rows)).collect()) == ranked(brute(rows))


def test_lockstep_over_ranges_inside_one_prefix(spark):
    """Ranges that begin inside a prefix see its count, and its extensions in all of them are compared."""
    rows = [("en", ["a"], 90)] + [("en", ["a", f"b{i:03}"], i + 1) for i in range(60)] + [("en", ["a", f"b{i:03}", "c"], 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "lang string, key array<string>, f long")
    for range_rows in (1_000, 9):
        found = {tuple(r.key): (r.parts, r.extension) for r in lockstep(frame.orderBy(F.rand(1)), range_rows).collect()}
        assert len(found) == len(rows) and found[("a",)] == ([], 60)
        assert all(found["a", f"b{i:03}"] == ([90], 1) and found["a", f"b{i:03}", "c"] == ([90, i + 1], 0) for i in range(60))
