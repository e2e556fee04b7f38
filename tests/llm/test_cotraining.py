from __future__ import annotations

import numpy as np

from logtide.llm.cotraining import CoTrainSettings, co_train, fit, quality_scores, score_documents


def two_views(rng, n):
    """Labels seen noisily by two independent views."""
    y = (rng.random(n) < 0.6).astype(float)
    views = []
    for width in (6, 4):
        x = rng.normal(size=(n, width)).astype(np.float32)
        x[:, 0] += 2.5 * (2 * y - 1)
        views.append(x)
    return tuple(views), y


def test_views_hand_labels_to_each_other_and_gain():
    rng = np.random.default_rng(1)
    (few, y), (pool, _), (test, truth) = two_views(rng, 40), two_views(rng, 3_000), two_views(rng, 3_000)
    model = co_train(few, y, pool, CoTrainSettings(sure=0.9))
    assert all(a > 0 and b > 0 for a, b in model.handed[:1])
    text, meta, both = ((p > 0.5) == truth for p in model.score(*test))
    assert both.mean() > 0.97 and both.mean() >= max(text.mean(), meta.mean()) - 0.01


def test_a_view_without_signal_hands_nothing_over():
    rng = np.random.default_rng(2)
    (a, _), y = two_views(rng, 400)
    noise = rng.normal(size=(400, 4)).astype(np.float32)
    model = co_train((a, noise), y, (a[:100], noise[:100]))
    assert sum(h[1] for h in model.handed) <= 2 and ((model.score(a, noise)[2] > 0.5) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(scored) == docs.count()
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if scored[r.doc_id].held_out]
    assert np.mean([s.kept == bool(q) for s, q in held]) > 0.93
    assert np.mean([s.kept for s, q in held if q]) > 0.97


def test_edge_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "long " * 50_000)], score="x", kept="y")
    model = fit(docs, labels)
    assert sorted((r.doc_id or 0) for r in score_documents(docs, model).collect()) == [0, 1, 1, 2, 3, 4]
    assert all(0 <= r.score <= 1 for r in score_documents(docs.select("doc_id", "text"), model).collect())
    assert score_documents(docs.limit(0), model).collect() == []
    assert len(quality_scores(docs, labels.limit(0)).collect()) == 6
