from __future__ import annotations

import random

import corpus_pipeline
from logtide.llm.line_dedup import drop_repeated_lines

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    """Windows of three lines, shorter runs of over 50 words, and whole texts of one or two lines; what is left of each text."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(filled)):
            for n in (1, 2, 3):
                window = tuple(lines[i] for i in filled[k:k + n])
                if len(window) < n:
                    break
                if n == 3 or len(" ".join(window).encode().split()) > 50 or n == len(filled):
                    if window in seen:
                        gone.update(range(k, k + n))
                    seen.add(window)
        if not gone or len(gone) < len(filled):
            out[doc_id] = text and "\n".join(line for i, line in enumerate(lines) if i not in {filled[k] for k in gone})
    return out


def test_short_texts_and_long_lines(make_docs):
    draw = random.Random(8)
    pieces = ["a", "b c", "", " ", "d e f", " ".join(["long"] * 51), " ".join(["half"] * 30), " ".join(["fifty"] * 50), "  two  " * 26]
    rows = [(i, "\n".join(draw.choice(pieces) + ("x" if draw.random() < 0.3 else "") for _ in range(draw.randint(0, 7)))) for i in range(200)]
    rows += [(900, "one line"), (901, "one line"), (902, "two\n\nlines"), (903, "two\nlines"), (904, None), (905, None)]
    assert {r.doc_id: r.text for r in drop_repeated_lines(make_docs(rows).repartition(5)).collect()} == brute(rows)


def test_stage_on_the_given_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    after = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, FOLDER)
    assert {r.doc_id: r.text for r in after.collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])
