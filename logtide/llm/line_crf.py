"""Operator 7: quality rules by labelling lines.

A linear-chain conditional random field marks every line of a text as content or boilerplate. It is fitted to
document labels that are passed on to the lines; decoding is Viterbi's. A document stays if the words in its content
lines have a large enough share, and if it passes the base rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import id_and_text, map_batches

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 10, 5, 20
#: Share of the words that must be in content lines.
CONTENT_SHARE = 0.5
NOTICE = re.compile(r"licen[sc]e|copyright|all rights reserved|https?://|cookie|subscribe", re.IGNORECASE)
ENDS = (".", "!", "?", ":", ";", "…", '"')


@dataclass(frozen=True)
class CrfSettings:
    """Bounds and weights of the fit."""

    max_rows: int = 4_000       # labelled documents, the first by hash of the id
    max_lines: int = 2_000      # labelled documents with more lines are not used to fit
    steps: int = 120
    ridge: float = 1e-3


@dataclass(frozen=True)
class LineCrf:
    """Log-linear weights for label 1 (content) against label 0 (boilerplate)."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    start: float
    trans: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, lines: Sequence[Sequence[int]]) -> list[int]:
        """Most likely labels of a sequence of lines, each given by its active features; ties go to content."""
        if not lines:
            return []
        weights, ((t00, t01), (t10, t11)) = self.weights, self.trans
        back: list[tuple[int, int]] = []
        zero, one = 0.0, self.start + sum(weights[i] for i in lines[0])
        for active in lines[1:]:
            a0, b0, a1, b1 = zero + t00, one + t10, zero + t01, one + t11
            back.append((int(b0 >= a0), int(b1 >= a1)))
            zero, one = max(a0, b0), max(a1, b1) + sum(weights[i] for i in active)
        label = int(one >= zero)
        out = [label]
        for before in reversed(back):
            label = before[label]
            out.append(label)
        return out[::-1]


def line_features(line: str, repeated: bool) -> list[str]:
    """Active features of one line."""
    words = line.split()
    n, chars = len(words), sum(map(len, words))
    letters = sum(map(str.isalpha, line))
    symbols = sum(map(line.count, SYMBOLS))
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    out = ["bias", f"words{min(5, int(math.log2(n + 1)))}", f"length{min(4, int(chars / max(n, 1) / 3))}"]
    out.append("symbols" + ("0" if not symbols else "1" if symbols * 20 < chars else "2"))
    if n and shouted * 2 > n:
        out.append("shouted")
    if line.count("!") * 4 > n:
        out.append("exclaims")
    if line.count("|") * 3 > n:
        out.append("listed")
    if n >= 6 and len(set(words)) * 2 < n:
        out.append("few distinct")
    if letters * 10 < chars * 7:
        out.append("few letters")
    if sum(map(str.isdigit, line)) * 5 > chars:
        out.append("digits")
    if repeated:
        out.append("repeated line")
    if NOTICE.search(line):
        out.append("notice")
    if line.rstrip(SPACE).endswith(ENDS):
        out.append("ends sentence")
    if line[:1].isupper():
        out.append("starts upper")
    return out


FEATURES = tuple(["bias", *(f"words{i}" for i in range(6)), *(f"length{i}" for i in range(5)), "symbols0", "symbols1", "symbols2", "shouted",
                  "exclaims", "listed", "few distinct", "few letters", "digits", "repeated line", "notice", "ends sentence", "starts upper"])
PLACE = {name: i for i, name in enumerate(FEATURES)}


def text_lines(text: str) -> tuple[list[list[int]], list[int], int]:
    """Features and words of every line that has a word, and the number of those that equal an earlier one."""
    seen: set[str] = set()
    features, words, repeats = [], [], 0
    for line in text.split("\n"):
        if not (n := len(line.encode().split())):
            continue
        repeated = line in seen
        repeats += repeated
        seen.add(line)
        features.append([PLACE[f] for f in line_features(line, repeated)])
        words.append(n)
    return features, words, repeats


def repeated_words(words: Sequence[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total = end = 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            total += at + size - max(at, end)
            end = at + size
    return total


def judge(text: str, crf: LineCrf) -> tuple[int, int, int, int, int, bool, bool, float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share)."""
    words = text.encode().split()
    features, of_line, repeats = text_lines(text)
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
    content = sum(n for n, label in zip(of_line, crf.viterbi(features)) if label)
    share = content / len(words) if words else 0.0
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), repeats, again,
            failed, not failed and share >= CONTENT_SHARE, share)


def fit(docs: DataFrame, labels: DataFrame, settings: CrfSettings = CrfSettings()) -> LineCrf:
    """Fit on documents whose quality is labelled; every line gets the label of its document.

    Null labels are none; an id with several labels counts as bad if one says so. Without labels every weight is zero,
    and every line is content.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows))
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `max_rows` pairs of numbers

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [text_lines(t or "")[0] for t in batch.column("text").to_pylist()]
        short = [r if len(r) <= settings.max_lines else [] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(short, pa.list_(pa.list_(pa.int8())))],
            ["doc_id", "quality", "lines"])

    table = map_batches(sample.select("doc_id", "text", "quality"), encode,
                        "doc_id long, quality int, lines array<array<byte>>").toArrow()  # bounded by the settings
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("quality").to_pylist(), table.column("lines").to_pylist()),
                  key=lambda r: (-len(r[2]), r[0], r[1], r[2]))
    return _climb([(r[2], int(r[1] > 0)) for r in rows if r[2]], settings)


def _climb(rows: list[tuple[list[list[int]], int]], settings: CrfSettings) -> LineCrf:
    """Gradient of the conditional likelihood by forward and backward sums, all sequences step by step; Adam."""
    n, width = len(rows), len(FEATURES)
    if not n:
        return LineCrf(FEATURES, (0.0,) * width, 0.0, ((0.0, 0.0), (0.0, 0.0)))
    longest = len(rows[0][0])
    alive = [sum(1 for r in rows if len(r[0]) > t) for t in range(longest)]  # rows are sorted by length
    first = np.concatenate([[0], np.cumsum(alive)]).astype(int)
    x = np.zeros((first[-1], width))
    for i, (lines, _) in enumerate(rows):
        for t, active in enumerate(lines):
            x[first[t] + i, active] = 1
    y = np.array([label for _, label in rows])
    gold = np.concatenate([y[:k] for k in alive])
    pairs = np.zeros((2, 2))
    for t in range(1, longest):
        k = alive[t]
        pairs[0, 0] += (y[:k] == 0).sum()
        pairs[1, 1] += (y[:k] == 1).sum()
    theta, m, v = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5)
    lines = len(x)
    for step in range(1, settings.steps + 1):
        w, start, trans = theta[:width], theta[width], theta[width + 1:].reshape(2, 2)
        state = np.zeros((lines, 2))
        state[:, 1] = x @ w
        state[:n, 1] += start
        forward, backward = np.empty_like(state), np.zeros_like(state)
        forward[:n] = state[:n]
        for t in range(1, longest):
            k, a, b = alive[t], first[t - 1], first[t]
            forward[b:b + k] = state[b:b + k] + np.logaddexp.reduce(forward[a:a + k, :, None] + trans, axis=1)
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            k, a, b = alive[t], first[t - 1], first[t]
            after = state[b:b + k] + backward[b:b + k]
            backward[a:a + k] = np.logaddexp.reduce(trans + after[:, None, :], axis=2)
            joint = forward[a:a + k, :, None] + trans + after[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(k, 4), axis=1)[:, None, None]
            expected += np.exp(joint).sum(axis=0)
        both = forward + backward
        chance = np.exp(both[:, 1] - np.logaddexp.reduce(both, axis=1))
        grad = np.empty_like(theta)
        grad[:width] = (gold - chance) @ x / lines
        grad[width] = (y - chance[:n]).sum() / lines
        grad[width + 1:] = (pairs - expected).ravel() / lines
        grad -= settings.ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    theta = theta.round(6).tolist()
    t = theta[width + 1:]
    return LineCrf(FEATURES, tuple(theta[:width]), theta[width], ((t[0], t[1]), (t[2], t[3])))


def quality_report(docs: DataFrame, labels: DataFrame, settings: CrfSettings = CrfSettings()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share).

    A null text is one without words and fails. Rows are judged one by one: repeated rows, null ids and other columns
    are fine; an empty table gives an empty result.
    """
    crf = fit(docs, labels, settings)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = list(zip(*(judge(t or "", crf) for t in batch.column(1).to_pylist()))) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return map_batches(id_and_text(docs), work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                       "n_repeat_words long, base_failed boolean, kept boolean, content_share double")
