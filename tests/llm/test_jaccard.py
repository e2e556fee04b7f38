from __future__ import annotations

import random

import corpus_pipeline
import pytest
from logtide.llm.jaccard import keep_one_of_similar, pairs_by_differences, shingle_set, similar_documents
from llm.test_simhash import roots

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    """By comparing all pairs."""
    sets, ids = {i: shingles(t) for i, t in texts.items()}, sorted(texts)
    return roots(ids, [(a, b) for a in ids for b in ids if a < b and similar(sets[a], sets[b])])


def near_copies(draw, n):
    """Texts with changed words, around the similarity that counts; some are chains, some short."""
    texts = {}
    for _ in range(n):
        words = [f"w{draw.randrange(5_000)}" for _ in range(draw.choice([3, 6, 40, 150, 400]))]
        for _ in range(draw.randint(1, 8)):
            texts[len(texts)] = " ".join(words)
            for at in draw.sample(range(len(words)), max(1, len(words) * draw.randint(1, 4) // 100)):
                words[at] = f"n{draw.randrange(5_000)}"
    return texts


def test_groups_against_all_pairs(make_docs):
    texts = near_copies(random.Random(5), 60)
    got = {r.doc_id: r.component_id for r in similar_documents(make_docs(list(texts.items())).repartition(5)).collect()}
    assert got == groups(texts)


def test_near_dedup_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, FOLDER).collect()}
    assert after == {i: rows[i] for i in set(groups({i: r.text for i, r in rows.items()}).values())}


def alike(draw, n, words, changed):
    """Copies of one text with as many words of their own each, far from each other."""
    base = [f"w{i}" for i in range(words)]
    for _ in range(n):
        own = list(base)
        for at in draw.sample(range(0, words, 6), changed):
            own[at] = f"o{draw.randrange(10**9)}"
        yield " ".join(own)


def test_alike_but_not_similar_texts_do_not_meet(spark, make_docs):
    """150 texts at a similarity of about 0.75 to each other, with some pairs of closer ones among them."""
    draw = random.Random(3)
    texts = dict(enumerate(alike(draw, 150, 600, 16)))
    for i in range(0, 12, 2):
        texts[len(texts)] = texts[i].replace(" w599", " x599")
    sets = {i: shingles(t) for i, t in texts.items()}
    true = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert 6 <= len(true) < 100
    hashed = {i: shingle_set(t.encode()) for i, t in texts.items()}
    nodes = spark.createDataFrame([(i, len(h), i, 0) for i, h in hashed.items()], "node long, n long, part long, group long")
    stored_sets = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in hashed.items()], "node long, shingles binary")
    met = {(r.a, r.b) for r in pairs_by_differences(nodes, stored_sets).collect()}
    assert linked(met, texts) == linked(true, texts) and len(met) < 500
    assert {r.doc_id: r.component_id for r in similar_documents(make_docs(list(texts.items()))).collect()} == groups(texts)


def linked(pairs, texts):
    return roots(sorted(texts), list(pairs))


@pytest.mark.parametrize("seed", range(4))
def test_differences_lose_no_link(spark, seed):
    """One group of near copies by random changes, another of unlike texts: found pairs that are similar link what all similar pairs do."""
    draw = random.Random(seed)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(120):
        words = list(base)
        for at in draw.sample(range(150), draw.randint(seed > 1, 9)):
            words[at] = f"n{draw.randrange(40 if seed % 2 else 10**6)}"
        texts[i] = " ".join(words[:draw.choice([150, 150, 140])])
    group = dict.fromkeys(texts, 0)
    for text in near_copies(draw, 20).values():
        group[len(texts)] = 1
        texts[len(texts)] = text
    hashed, sets = {i: shingle_set(t.encode()) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    nodes = spark.createDataFrame([(i, len(h), i, group[i]) for i, h in hashed.items()], "node long, n long, part long, group long")
    stored_sets = spark.createDataFrame([(i, bytearray(h.tobytes())) for i, h in hashed.items()], "node long, shingles binary")
    met = {(r.a, r.b) for r in pairs_by_differences(nodes, stored_sets).collect()}
    true = {(a, b) for a in sets for b in sets if a < b and group[a] == group[b] and similar(sets[a], sets[b])}
    assert linked({(a, b) for a, b in met if similar(sets[a], sets[b])}, texts) == linked(true, texts)
    assert len(met) < 3_000


def test_edge_rows(make_docs):
    text = "some words that make a text of a fair length for hashing"
    rows = [(5, None), (3, ""), (9, text), (7, text), (7, text), (None, "alone without an id"), (None, "alone without an id"), (8, "other words here now")]
    docs = make_docs(rows, node="x", component_id="y")
    kept = keep_one_of_similar(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 8]
    assert keep_one_of_similar(docs.limit(0)).collect() == []
