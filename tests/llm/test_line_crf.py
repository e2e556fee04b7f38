from __future__ import annotations

import itertools
import random
import re

import numpy as np

from logtide.llm.line_crf import FEATURES, LineCrf, fit, quality_report, repeated_words


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_viterbi_against_all_labellings():
    draw = random.Random(4)
    for _ in range(60):
        crf = LineCrf(FEATURES, tuple(draw.uniform(-2, 2) for _ in FEATURES), draw.uniform(-1, 1),
                      tuple(tuple(draw.uniform(-2, 2) for _ in range(2)) for _ in range(2)))
        lines = [draw.sample(range(len(FEATURES)), 4) for _ in range(draw.randint(1, 8))]

        def value(labels):
            total = crf.start * labels[0] + sum(sum(crf.weights[i] for i in f) for f, y in zip(lines, labels) if y)
            return total + sum(crf.trans[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        assert abs(value(crf.viterbi(lines)) - value(best)) < 1e-9
    assert crf.viterbi([]) == []


def test_base_columns(spark, make_docs):
    draw = random.Random(2)
    rows = [(i, draw.choice([" ", "\n", "\t"]).join(draw.choice(["a", "b", "é#", " c", "d|", "\x85", "of"]) for _ in range(draw.randint(0, 40))))
            for i in range(60)] + [(100, None), (101, ""), (102, "a\n\na\n \n a\na"), (103, "x y z w v " * 3), (None, "z")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows, kept="a", n_words="b")
    got = {r.doc_id: tuple(r)[1:7] for r in quality_report(docs, labels).collect()}
    assert got == {i: slow_base(t) for i, t in rows}
    assert quality_report(docs.limit(0), labels).collect() == []
    none = quality_report(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_repeated_words_of_a_long_text():
    words = [b"%d" % (i % 70_000) for i in range(100_000)]
    assert repeated_words(words) == 60_000
    assert repeated_words([b"a"] * 9) == 9 and repeated_words([]) == 0


def test_verdicts_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("crc32(string(doc_id)) % 2 = 0"), {r.doc_id: r.quality for r in labels.where("crc32(string(doc_id)) % 2 = 1").collect()}
    rows = [r for r in quality_report(docs, train).collect() if r.doc_id in test and not r.base_failed]
    assert np.mean([r.kept == bool(test[r.doc_id]) for r in rows]) > 0.95
    good = [r.kept for r in rows if test[r.doc_id]]
    assert np.mean(good) > 0.98
    assert fit(docs, train) == fit(docs.repartition(7), train)
