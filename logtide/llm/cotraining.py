"""Operator 2: quality classifier by co-training.

Two views of a document are classified apart: its text (shapes of words, shares of repeats, symbols and capitals) and its
page metadata (language, source, length). In every round each view is fitted to what is labelled so far, calibrated on
labels that are set aside, and hands the unlabelled documents it is most sure of to the other view. The calibrated
views are then combined, again on the labels set aside, and score all documents.

The fit sees `labelled` labelled and `pool` unlabelled documents at most, the first by hash of the id; the passes that
make features and scores are distributed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import BoundedTable, map_batches

SHAPES, PARTS = 240, ("lang", "source", "length")
NUMBERS = ("distinct words", "upper words", "symbols", "digits", "mean word", "mean line", "repeated lines", "few words", "letters",
           "largest word share")
TEXT_WIDTH = SHAPES + len(NUMBERS)
META_WIDTHS = {"lang": 32, "source": 128, "length": 24}
META_WIDTH = sum(META_WIDTHS.values())
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Characters that are counted as no letters.
NO_LETTERS = " \t\n\r0123456789.,;:!?'\"()[]{}<>|#*$%&@/\\+-_=~^`"
#: Kept from this score on.
THRESHOLD = 0.5


@dataclass(frozen=True)
class CoTrainSettings:
    """Bounds and weights of the fit."""

    labelled: int = 8_000
    pool: int = 8_000
    rounds: int = 4
    handed: int = 400        # pseudo-labels that a view hands over in a round, split by the share of the classes
    sure: float = 0.95       # calibrated probability that a pseudo-label needs
    steps: int = 150
    ridge: float = 1e-3


def _shape(word: str) -> int:
    """Bucket of a word's shape: runs of small and capital letters and digits are one sign each, the rest stays."""
    form = LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return zlib.crc32(DIGITS.sub("0", form).encode()) % SHAPES


#: Shapes of the words that a process has met.
_KNOWN = BoundedTable(_shape, 100_000)


def text_features(text: str) -> np.ndarray:
    """Features of a text: shares of word shapes and a few numbers between 0 and about 1."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    out = np.zeros(TEXT_WIDTH, np.float32)
    n, chars = max(len(words), 1), max(len(text), 1)
    if words:
        buckets = np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words))
        out[:SHAPES] = np.sqrt(np.bincount(buckets, minlength=SHAPES) / n)
    counts = Counter(words)
    letters = len(text) - sum(map(text.count, NO_LETTERS))
    out[SHAPES:] = (len(counts) / n, sum(map(str.isupper, words)) / n, sum(map(text.count, "#*$%&|<>!")) / chars * 5,
                    sum(map(text.count, "0123456789")) / chars * 5, min(1.0, chars / n / 20), min(1.0, len(words) / max(len(lines), 1) / 50),
                    1 - len(set(lines)) / max(len(lines), 1), float(len(words) < 10), letters / chars, max(counts.values(), default=0) / n)
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Active features of the metadata; a missing value is a value of its own."""
    length = 0 if n_chars is None else 1 + min(META_WIDTHS["length"] - 2, int(2 * math.log10(max(n_chars, 1)) * 2))
    values = (zlib.crc32(repr(lang).encode()) % META_WIDTHS["lang"], zlib.crc32(repr(source).encode()) % META_WIDTHS["source"], length)
    out, base = [], 0
    for part, value in zip(PARTS, values):
        out.append(base + value)
        base += META_WIDTHS[part]
    return out


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.zeros((batch.num_rows, TEXT_WIDTH), np.float32)
    meta = np.zeros((batch.num_rows, META_WIDTH), np.float32)
    columns = (batch.column(c).to_pylist() for c in ("text", *PARTS))
    for i, (t, *values) in enumerate(zip(*columns)):
        text[i] = text_features(t or "")
        meta[i, meta_features(*values)] = 1
    return text, meta


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights and, last, the bias of a logistic model, by Adam over all rows."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    keep = np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    for step in range(1, steps + 1):
        error = _sigmoid(x @ w.astype(np.float32)) - y
        grad = error.astype(np.float32) @ x / max(len(x), 1) + keep * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w.round(6)


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    scale: np.ndarray  # calibration: slope and intercept on the raw score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_raw(x, self.weights) * self.scale[0] + self.scale[1])


@dataclass(frozen=True)
class CoTrained:
    text: View
    meta: View
    joint: np.ndarray
    handed: tuple[tuple[int, int], ...]  # pseudo-labels taken by (meta, text) in each round

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.probability(text), self.meta.probability(meta)
        return a, b, _sigmoid(_raw(np.column_stack([_logit(a), _logit(b)]), self.joint))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
             settings: CoTrainSettings = CoTrainSettings()) -> CoTrained:
    """Fit both views; every fifth labelled row is set aside to calibrate and combine them."""
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 10 else np.ones(len(y), bool)
    own = ~aside if len(y) >= 10 else np.ones(len(y), bool)
    share = float(y.mean()) if len(y) else 0.5
    taken = [np.zeros(len(pool[0]), bool) for _ in views]   # of the pool, by the view that learns from it
    guess = [np.zeros(len(pool[0])) for _ in views]
    history = []

    def fitted(k: int) -> View:
        x = np.vstack([views[k][own], pool[k][taken[k]]])
        weights = logistic(x, np.append(y[own], guess[k][taken[k]]), settings.steps, settings.ridge)
        scale = logistic(_raw(views[k][aside], weights)[:, None], y[aside], settings.steps, 1e-2)
        return View(weights, scale)

    both = [fitted(k) for k in range(2)]
    for _ in range(settings.rounds):
        before = [int(t.sum()) for t in taken]
        for k in range(2):
            p, other = both[k].probability(pool[k]), 1 - k
            for label, sureness, part in ((1, p, share), (0, 1 - p, 1 - share)):
                free = np.flatnonzero(~taken[other] & (sureness >= settings.sure))
                best = free[np.argsort(-sureness[free], kind="stable")][:max(1, round(settings.handed * part))]
                taken[other][best], guess[other][best] = True, label
        history.append((int(taken[1].sum()) - before[1], int(taken[0].sum()) - before[0]))
        both = [fitted(k) for k in range(2)]
    a, b = (both[k].probability(views[k][aside]) for k in range(2))
    joint = logistic(np.column_stack([_logit(a), _logit(b)]), y[aside], settings.steps, 1e-3)
    return CoTrained(both[0], both[1], joint, tuple(history))


def _document_columns(docs: DataFrame) -> DataFrame:
    """The used columns under fixed names; metadata that a table does not have is null."""
    def column(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column("text", "string").alias("text"),
                       column("lang", "string").alias("lang"), column("source", "string").alias("source"),
                       column("n_chars", "long").alias("length"))


def fit(docs: DataFrame, labels: DataFrame, settings: CoTrainSettings = CoTrainSettings()) -> CoTrained:
    """Fit on labelled documents and a pool of documents without a label.

    Null labels are none; an id with several labels counts as bad if one says so.
    """
    rows = _document_columns(docs)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    free = rows.select("doc_id").where("doc_id IS NOT NULL").join(seen, "doc_id", "left_anti").distinct()
    chosen = (known.orderBy(*order).limit(settings.labelled)
              .unionByName(free.orderBy(*order).limit(settings.pool).withColumn("quality", F.lit(None).cast("int"))))
    sample = rows.join(F.broadcast(chosen), "doc_id")  # two numbers for each row of the bounded sample

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, meta = _features(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(list(text), pa.list_(pa.float32())),
             pa.array(list(meta), pa.list_(pa.float32()))], ["doc_id", "quality", "text", "meta"])

    table = map_batches(sample.select("doc_id", "quality", "text", *PARTS), encode,
                        "doc_id long, quality int, text array<float>, meta array<float>").toArrow()  # bounded by the settings
    table = table.sort_by([("doc_id", "ascending")])
    quality = np.array([np.nan if q is None else float(q > 0) for q in table.column("quality").to_pylist()])
    views = tuple(table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, w)
                  for c, w in (("text", TEXT_WIDTH), ("meta", META_WIDTH)))
    has = ~np.isnan(quality)
    return co_train(tuple(v[has] for v in views), quality[has], tuple(v[~has] for v in views), settings)


def score_documents(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every document.

    A null text is one without words, missing metadata a value of its own. Rows are scored one by one: repeated rows, null
    ids and other columns are fine; an empty table gives an empty result.
    """
    names = ["doc_id", "text_score", "meta_score", "score", "kept"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            a, b, both = (s.astype(np.float64).round(9) for s in model.score(*_features(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= THRESHOLD)], names)

    return map_batches(_document_columns(docs), work, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, settings: CoTrainSettings = CoTrainSettings()) -> DataFrame:
    """Fit on the labels that are not held out (as for toxicity) and score every document, with `held_out`."""
    from logtide.llm.toxicity import held_out

    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), settings)
    return score_documents(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
