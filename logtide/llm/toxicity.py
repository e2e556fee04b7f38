"""Operator 10: toxicity classifier with counterfactual regularisation.

A logistic model on the words of a text and the beginnings of its words. Besides the labels it is fitted to
counterfactuals: in every labelled sentence that names a group, the name is swapped for others, and the squared
change of the score (as log odds) is penalised. A mention of a group alone then moves no score, so neutral
mentions are no false positives.

Features are chosen by counts over all rows of the fitting sample, which Spark makes; the fit sees at most
`max_rows` labelled rows with at most `features` features each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from logtide.llm.common import BoundedTable, id_and_text, map_batches, small_batches, stored

#: Groups that a sentence can name; a term is swapped for others of its row.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "straight", "lesbian", "heterosexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"), ("blind", "deaf", "disabled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6)
#: Predicted toxic from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class FitSettings:
    """Bounds and weights of the fit."""

    max_rows: int = 20_000      # labelled rows, the first by hash of the id
    bits: int = 20              # features are counted in 2**bits buckets
    features: int = 1_024       # buckets that the model uses
    steps: int = 500
    ridge: float = 1e-5
    counterfactual: float = 1.0  # weight of the penalty on swapped sentences
    swaps: int = 3              # counterfactuals of each named group in a sentence


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of label 1; a null text scores as an empty one."""
        known = dict(zip(self.buckets.tolist(), range(len(self.buckets))))
        table = BoundedTable(lambda word: tuple(known[b] for b in word_buckets(word, self.bits) if b in known), 100_000)
        logits = np.empty(len(texts))
        for i, text in enumerate(texts):
            active: set[int] = set()
            for found in map(table.__getitem__, set(WORD.findall((text or "").lower()))):
                if found:
                    active.update(found)
            logits[i] = self.bias + self.weights[sorted(active)].sum()
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def word_buckets(word: str, bits: int) -> list[int]:
    """Buckets of a word and of its beginnings."""
    mask = (1 << bits) - 1
    out = [zlib.crc32(b"=" + word.encode()) & mask]
    out += [zlib.crc32(word[:n].encode()) & mask for n in PREFIXES if len(word) >= n]
    return out


def text_buckets(text: str, bits: int) -> set[int]:
    return {b for word in set(WORD.findall(text.lower())) for b in word_buckets(word, bits)}


def counterfactuals(text: str, terms: dict[str, tuple[str, ...]], swaps: int) -> Iterator[tuple[str, str]]:
    """(sentence, sentence with a named group swapped); which others are taken follows from the sentence."""
    for sentence in SENTENCE.findall(text.lower()):
        words = WORD.findall(sentence)
        for term in sorted(terms.keys() & set(words)):
            others = [t for t in terms[term] if t != term]
            first = zlib.crc32(sentence.encode())
            for k in range(min(swaps, len(others))):
                other = others[(first + k) % len(others)]
                yield sentence, re.sub(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", other, sentence)


def fitting_sample(docs: DataFrame, labels: DataFrame, settings: FitSettings) -> DataFrame:
    """At most `max_rows` labelled rows (doc_id, text, toxic): the first by hash of the id.

    A label that is null is none; if an id has several labels, one that says toxic wins. Ids without a document
    give nothing.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows))
    # at most `max_rows` pairs of numbers, so sending them everywhere is bounded
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings(),
        identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on labelled documents; the caller has taken out those that are held out.

    Without a labelled row the model has no features and scores everything 0.5.
    """
    sample = stored(fitting_sample(docs, labels, settings), "toxicity-sample")
    bits = settings.bits
    terms = {t: tuple(group) for group in identity_terms for t in group}

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = np.fromiter(text_buckets(text or "", bits), np.int64)
            total[int(toxic > 0), found] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])],
                                         ["bucket", "clean", "toxic"])

    sizes = {int(r["kind"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("kind"))
             .agg(F.count("*").alias("n")).collect()}  # two rows
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean and not n_toxic:
        return ToxicityModel(bits, np.zeros(0, np.int64), np.zeros(0), 0.0)
    counted = (map_batches(sample.select("text", "toxic"), count, "bucket long, clean long, toxic long")
               .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    # likelihood ratio of a bucket's labels against the labels of all rows: rare but one-sided buckets count as well
    rows, rate = F.col("clean") + F.col("toxic"), n_toxic / (n_clean + n_toxic)
    gain = sum((F.when(F.col(kind) > 0, F.col(kind) * F.log(F.col(kind) / (rows * max(share, 1e-9)))).otherwise(0.0)
                for kind, share in (("toxic", rate), ("clean", 1 - rate))), F.lit(0.0))
    best = counted.withColumn("gain", F.round(gain, 6)).orderBy(F.desc("gain"), "bucket").limit(settings.features).select("bucket")
    named = {b for t in terms for b in word_buckets(t, bits)}  # swaps must be visible to the model
    buckets = np.array(sorted({r["bucket"] for r in best.collect()} | named), np.int64)
    place = {int(b): i for i, b in enumerate(buckets)}

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        active, changes = [], []
        for text in batch.column("text").to_pylist():
            active.append(sorted(place[b] for b in text_buckets(text or "", bits) if b in place))
            own = []
            for plain, swapped in counterfactuals(text or "", terms, settings.swaps):
                x, y = (text_buckets(s, bits) for s in (plain, swapped))
                own.append(sorted([-1 - place[b] for b in x - y if b in place] + [place[b] for b in y - x if b in place]))
            changes.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(active, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))],
            ["toxic", "active", "changes"])

    rows = map_batches(sample.select("text", "toxic"), encode, "toxic int, active array<int>, changes array<array<int>>")
    table = rows.toArrow()  # at most `max_rows` rows of small numbers
    y = (table.column("toxic").to_numpy() > 0).astype(np.float32)
    x = np.zeros((len(y), len(buckets)), np.float32)
    at = 0
    for chunk in table.column("active").chunks:
        counts = np.diff(chunk.offsets.to_numpy())
        x[np.repeat(np.arange(at, at + len(chunk)), counts), chunk.flatten().to_numpy()] = 1
        at += len(chunk)
    # equal changes are one row with a weight: a frequent sentence is no longer than a rare one
    distinct: dict[tuple[int, ...], int] = {}
    for own in table.column("changes").to_pylist():
        for change in own:
            distinct[tuple(change)] = distinct.get(tuple(change), 0) + 1
    delta = np.zeros((len(distinct), len(buckets)), np.float32)
    for i, change in enumerate(distinct):
        for c in change:
            delta[i, c if c >= 0 else -1 - c] += 1 if c >= 0 else -1
    share = np.array(list(distinct.values()), np.float32)
    weights, bias = _descend(x, y, delta, share / max(1.0, share.sum()), settings)
    return ToxicityModel(bits, buckets, weights, bias)


def _descend(x: np.ndarray, y: np.ndarray, delta: np.ndarray, share: np.ndarray,
             settings: FitSettings) -> tuple[np.ndarray, float]:
    """Minimise log loss + ridge + counterfactual penalty by Adam over the whole sample, in row order of its sum."""
    n, width = x.shape
    theta = np.zeros(width + 1)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    theta[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.steps + 1):
        w = theta[:-1].astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(theta[-1]), -30, 30)))
        error = p - y
        grad = np.empty_like(theta)
        grad[:-1] = error @ x / n + settings.ridge * theta[:-1]
        if len(delta):
            grad[:-1] += 2 * settings.counterfactual * ((share * (delta @ w)) @ delta)
        grad[-1] = error.mean()
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1].round(6), float(theta[-1].round(6))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Score of a text column, 0 to 1."""
    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned: CRC-32 of the id as text, modulo 4, is 2; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    """Fit on the labels that are not held out and score every document: (doc_id, held_out, score, predicted).

    Null and empty texts get the score of a text without words. Repeated rows and ids are scored one by one; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    own = id_and_text(docs)
    model = fit(own, labels.where(~held_out(F.col("doc_id"))), settings)
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), settings)
    return docs.where(toxicity_score(model, F.col("text")) < THRESHOLD)
