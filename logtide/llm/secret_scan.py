"""Operator 8: secrets by patterns and by randomness tests.

Base patterns find assignments, access keys and hexadecimal strings. Beyond them, every token with an inferred encoding
is put to a battery of tests of randomness over its alphabet: chi-squared uniformity, runs above and below the middle,
and serial correlation. Their p-values are combined; a token that does not look random is no secret.

Short tokens pass such tests easily. So for each token a decoy of the same length is made of the ordinary text before it
and tested in the same way. For every class of lengths the accepted level is the lowest at which decoys that pass are at
most a share `rate` of the tokens that pass. Levels come from counts over all documents.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import id_and_text, map_batches, stored

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs, as of one character or more
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ORDINARY = re.compile(r"[^\W\d_]+")
#: Encodings from the narrowest; a token belongs to the first whose alphabet has all its characters.
ENCODINGS = (
    ("hex", string.digits + "abcdef"), ("HEX", string.digits + "ABCDEF"), ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase), ("BASE36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
PLACES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS}
#: Smallest lengths of the classes, and steps of the level.
LENGTHS, LEVELS = (16, 20, 24, 32, 40, 64, 128), 200
#: Accepted share of false discoveries, and the level below which a token is never random.
RATE, LEAST_LEVEL = 0.05, 0.01


def infer_encoding(token: str) -> str | None:
    """Narrowest encoding of a token; none for words, numbers and names joined by signs."""
    bare = token.rstrip("=")
    kinds = (any(map(str.isdigit, bare)), any(map(str.islower, bare)), any(map(str.isupper, bare)))
    if not kinds[0] or sum(kinds) < 2:
        return None
    return next((name for name, places in PLACES.items() if all(c in places for c in bare)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(codes: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of (uniform over the alphabet, runs, serial correlation) for symbols 0 to size - 1; all by normal moments."""
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi = float((counts * counts).sum() * size / n - n)
    # exact mean and variance of the statistic under uniformity; large values are evidence against it
    z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = codes * 2 >= size
    a = int(high.sum())
    b = n - a
    if a and b:
        mean, seen = 1 + 2 * a * b / n, 1 + int((high[1:] != high[:-1]).sum())
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = _two_sided((seen - mean) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    spread = codes - codes.mean()
    power = float((spread * spread).sum())
    serial = _two_sided(float((spread[1:] * spread[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    return uniform, runs, serial


def level(token: str, encoding: str) -> float:
    """Combined p-value (Fisher) of the battery: near 0 for text, uniform for random tokens."""
    places = PLACES[encoding]
    codes = np.array([places[c] for c in token.rstrip("=") if c in places], np.int64)
    if len(codes) < 2:
        return 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in battery(codes, len(places)))
    return math.exp(-half) * (1 + half + half * half / 2)


def length_class(n: int) -> int:
    return sum(1 for least in LENGTHS if n >= least) - 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in the order of the result."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def decoy(text: str, start: int, n: int, encoding: str) -> str:
    """Ordinary text of the length of a token, in its alphabet: the words before it, else those after it."""
    places = PLACES[encoding]
    for part in (text[max(0, start - 4 * n - 40):start], text[start + n:start + 5 * n + 40]):
        letters = "".join(w for w in ORDINARY.findall(part))
        for form in (letters, letters.lower(), letters.upper()):
            own = "".join(c for c in form if c in places)
            if len(own) >= n:
                return own[-n:]
    return ""


def candidates(text: str, covered: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, float, float]]:
    """(start, end, level, level of the decoy or -1) of the tokens with an encoding that no base pattern covers."""
    for m in TOKEN.finditer(text):
        encoding = infer_encoding(m[0])
        if encoding and not any(s < m.end() and m.start() < e for s, e, _ in covered):
            other = decoy(text, m.start(), len(m[0]), encoding)
            yield m.start(), m.end(), level(m[0], encoding), level(other, encoding) if other else -1.0


SCANNED = ("id long, base array<struct<start: int, stop: int, kind: string>>, "
           "tried array<struct<start: int, stop: int, class: int, level: int, decoy: int>>")


def _step(p: float) -> int:
    return min(LEVELS - 1, int(p * LEVELS)) if p >= 0 else -1


def scan(docs: DataFrame) -> DataFrame:
    """(id, base, tried): base spans and tested tokens of every text, one row for each row of `docs`."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, tried = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            base.append([{"start": s, "stop": e, "kind": k} for s, e, k in found])
            tried.append([{"start": s, "stop": e, "class": length_class(e - s), "level": _step(p), "decoy": _step(q)}
                          for s, e, p, q in candidates(text, found)])
        whole = pa.struct([(n, pa.int32()) for n in ("start", "stop", "class", "level", "decoy")])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))),
             pa.array(tried, pa.list_(whole))], ["id", "base", "tried"])

    return map_batches(id_and_text(docs), work, SCANNED)


def accepted_levels(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """For each class of lengths the lowest accepted step of the level, `LEVELS` for none; from counts over all rows."""
    counts = np.zeros((2, len(LENGTHS), LEVELS), np.int64)
    one = scanned.where(F.size("tried") > 0).select(F.explode("tried").alias("t")).select("t.*")
    rows = (one.select("class", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("level").alias("at")),
                                                 F.struct(F.lit(1).alias("kind"), F.col("decoy").alias("at")))).alias("x"))
            .where("x.at >= 0").groupBy("class", "x.kind", "x.at").agg(F.count("*").alias("n")))
    for r in rows.collect():  # two kinds, the classes, the steps
        counts[r["kind"], r["class"], r["at"]] = r["n"]
    tokens, decoys = (np.cumsum(c[:, ::-1], axis=1)[:, ::-1] for c in counts)
    least = math.ceil(LEAST_LEVEL * LEVELS)
    return [next((s for s in range(least, LEVELS) if tokens[c, s] and decoys[c, s] <= rate * tokens[c, s]), LEVELS)
            for c in range(len(LENGTHS))]


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(id, base, spans): base spans and all spans (array of start, stop, kind) of every row, in order.

    A null text is empty. Rows are independent but for the levels; repeated rows, null ids and other columns are fine. An
    empty table gives an empty result. Offsets count code points.
    """
    scanned = stored(scan(docs), "secrets")
    limits = F.array(*[F.lit(s) for s in accepted_levels(scanned, rate)])
    passed = F.filter("tried", lambda t: t["level"] >= F.element_at(limits, t["class"] + 1))
    more = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.lit("random").alias("kind")))
    rank = {k: i for i, k in enumerate(KINDS)}

    def keyed(s):
        order = F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in rank.items()])
        return F.struct(s["start"].alias("start"), order.alias("order"), s["stop"].alias("stop"), s["kind"].alias("kind"))

    spans = F.sort_array(F.transform(F.concat("base", more), keyed))
    return scanned.select("id", "base", spans.alias("spans"))


def secrets_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(F.col("id").alias("doc_id"), *map(number, KINDS[:3]),
                                     F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
