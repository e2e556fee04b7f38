from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from logtide.llm import toxicity
from logtide.llm.toxicity import FitSettings, counterfactuals, drop_toxic, fit, score_documents

NEUTRAL = "the walk by the river was long and the weather was fine for people who like to read old books at home".split()


def sentences(seed, n, insult_near_group=0.8):
    """Insults are toxic; the word `muslim` mostly stands near one, so a plain fit would blame the word."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = draw.choices(NEUTRAL, k=30)
        toxic = int(draw.random() < 0.4)
        if toxic:
            words[draw.randrange(30)] = draw.choice(["blargface", "zonkhead"])
        if draw.random() < (insult_near_group if toxic else 0.05):
            words[draw.randrange(30)] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture
def labelled(spark, make_docs):
    rows, labels = sentences(1, 400)
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counterfactual_penalty_removes_the_weight_of_a_group(labelled):
    neutral = ["the weather was fine for a muslim at home", "the weather was fine for a christian at home"]
    plain = fit(*labelled, FitSettings(counterfactual=0.0)).score(neutral)
    regular = fit(*labelled, FitSettings(counterfactual=10.0))
    assert plain[0] - plain[1] > 0.1
    scores = regular.score(neutral)
    assert abs(scores[0] - scores[1]) < 0.01 and scores[0] < plain[0]
    assert regular.score(["the weather was fine for a blargface"])[0] > 0.9


def test_swapped_sentences():
    terms = {t: ("muslim", "christian", "jewish") for t in ("muslim", "christian", "jewish")}
    found = list(counterfactuals("A Muslim reads. Nothing here. premuslim", terms, 5))
    assert {b for a, b in found} == {"a christian reads", "a jewish reads"} and {a for a, _ in found} == {"a muslim reads"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert len(scored) == docs.count()
    held = [(scored[r.doc_id], r.toxic) for r in labels.collect() if scored[r.doc_id].held_out]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in scored)
    right = np.mean([s.predicted == toxic for s, toxic in held])
    assert right > 0.9, right
    assert all(s.predicted == int(s.score >= 0.3) and 0 <= s.score <= 1 for s in scored.values())


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, labelled):
    docs, labels = labelled
    one = sorted(score_documents(docs, labels).collect())
    other = labels.selectExpr("doc_id", "0 quality", "IF(crc32(string(doc_id)) % 4 = 2, 1 - toxic, toxic) toxic")
    assert one == sorted(score_documents(docs.withColumn("lang", docs["text"]).withColumn("score", docs["text"]), other).collect())


def test_edge_rows(spark, make_docs, labelled):
    rows = [(1, None), (2, ""), (3, "blargface"), (3, "blargface"), (None, "blargface"), (4, "the " * 50_000)]
    docs = make_docs(rows, toxic="x", predicted="y")
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (4, 1, 0), (2, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = labels.limit(0)
    assert {r.score for r in score_documents(docs, empty).collect()} == {0.5}
    assert score_documents(docs.limit(0), labels).collect() == []
    kept = drop_toxic(labelled[0], labelled[1])
    assert kept.schema == labelled[0].schema
    toxic = {r.doc_id for r in labelled[1].collect() if r.toxic}
    assert len({r.doc_id for r in kept.collect()} & toxic) < 5 and kept.count() > 200


def test_sample_is_bounded(labelled):
    assert toxicity.fitting_sample(*labelled, FitSettings(max_rows=10)).count() == 10
