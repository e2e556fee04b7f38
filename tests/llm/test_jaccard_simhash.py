"""The pigeonring's share in the near-duplicate stage."""

from __future__ import annotations

import random

from llm.test_jaccard import groups, near_copies, shingles, similar
from llm.test_simhash import roots
from logtide.llm.jaccard import CLOSE_BITS, close_nodes, shingle_set, signatures, similar_documents, similar_pairs
from logtide.llm.simhash import majority_bits
from pyspark.sql import functions as F


def long_copies(draw):
    """Texts of 600 words, copies with one word changed, and unlike texts."""
    texts = {}
    for i in range(12):
        words = [f"w{draw.randrange(5_000)}" for _ in range(600)]
        for _ in range(3):
            texts[len(texts)] = " ".join(words)
            words[draw.randrange(600)] = f"n{i}"
    return texts


def nodes_of(docs, keys):
    return signatures(docs).select("doc_id", "node", "n", "fp", keys.alias("keys"), F.col("doc_id").alias("at_id"), F.col("version").alias("at_version"))


def test_candidates_are_found_without_bands(make_docs):
    """Close fingerprints alone link what is similar; no pair that is not similar passes."""
    texts = long_copies(random.Random(4))
    docs = make_docs(list(texts.items()))
    prints = {i: majority_bits(shingle_set(t.encode())) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    close = {(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= CLOSE_BITS}
    assert len(close) > 12 and all(similar(sets[a], sets[b]) for a, b in close)
    nodes = nodes_of(docs, F.expr("cast(array() as array<long>)"))
    ids = {r.node: r.doc_id for r in nodes.collect()}
    met = {tuple(sorted((ids[r.a], ids[r.b]))) for r in similar_pairs(docs, nodes).collect()}
    assert met and all(similar(sets[a], sets[b]) for a, b in met)
    assert roots(sorted(texts), list(met)) == roots(sorted(texts), list(close))


def test_buckets_of_close_fingerprints(spark):
    """Each pair of close or equal fingerprints shares a bucket; a text without words has none."""
    rows = [(1, 5, 0b0), (2, 5, 0b0), (3, 5, 0b1111), (4, 5, 0b11111), (5, 0, 0)]
    buckets = {}
    for r in close_nodes(spark.createDataFrame(rows, "node long, n long, fp long")).collect():
        buckets.setdefault(r.key, []).append(r.node)
    assert sorted(map(sorted, buckets.values())) == [[1, 2, 3], [3, 4], [4]]


def test_groups_are_those_of_all_pairs(make_docs):
    texts = near_copies(random.Random(11), 30) | {1_000 + i: t for i, t in long_copies(random.Random(12)).items()}
    got = {r.doc_id: r.component_id for r in similar_documents(make_docs(list(texts.items()))).collect()}
    assert got == groups(texts)
