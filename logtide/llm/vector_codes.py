"""Operator 11: vector code compression (product quantisation) with norm-of-sum bounds.

Components become whole numbers, floor(256 * x); vectors are cut into equal consecutive parts and each part position has a
codebook. A round assigns every part to the nearest entry of its codebook and moves each entry to the floored mean of its
parts; after the last round parts are assigned once more.

A part that has been compared with all entries keeps the distance to the second nearest one as a lower bound, with the
round of that scan as its stamp. All codebooks of earlier rounds are kept, so that in a later round the bound
is lowered by the true net displacement of the other entries since its stamp (the norm of the sum of their moves, which
may cancel), not by the sum of the single drifts. Only a part whose own entry is not clearly nearer than that is compared
with all entries again, and gets a new bound and stamp. Distances are whole numbers, and comparisons leave a margin for
the rounding of their roots: results are those of full scans.

Codebooks have a fixed size and are what the driver holds; vectors, their codes, bounds and stamps stay in tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import map_batches, small_batches, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Whole numbers beyond this are refused: squared distances have to fit into 64 bits.
LARGEST = 1 << 27
#: Relative room for the rounding of square roots.
MARGIN = 1e-9
#: Differences that are in memory at a time.
BLOCK = 1 << 21
#: Stretches that the rows of one label are spread over.
SALTS = 16

STATE = "vec_id long, label {label}, x array<int>, code binary, bound binary, stamp binary, error long, scans int"


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x array<double>) of the vectors without null or non-finite components, x being floor(256 * component)."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                        F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("x").isNotNull() & fine).withColumn("x", F.transform("x", lambda c: F.floor(c * 256).cast("double")))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row of `x` from each entry."""
    out = np.empty((len(x), len(entries)), np.int64)
    step = max(1, BLOCK // max(1, entries.size))
    for at in range(0, len(x), step):
        difference = x[at:at + step, None, :] - entries[None]
        out[at:at + step] = np.einsum("ijk,ijk->ij", difference, difference)
    return out


class History:
    """The codebooks of all rounds so far, and how far entries have moved between two of them."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books  # each of shape (parts, entries, width)
        self.now = len(books) - 1
        #: For each earlier round, part and entry: the furthest net displacement of any other entry.
        self.others = [self._furthest_other(b) for b in books]

    def _furthest_other(self, then: np.ndarray) -> np.ndarray:
        moved = np.sqrt(((self.books[-1] - then) ** 2).sum(axis=2).astype(np.float64))
        if moved.shape[1] < 2:
            return np.zeros_like(moved)
        order = np.sort(moved, axis=1)
        most, second = order[:, -1:], order[:, -2:-1]
        own_is_most = np.arange(moved.shape[1])[None] == moved.argmax(axis=1)[:, None]
        return np.where(own_is_most, second, most)

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Assign the parts of `x` (rows, parts, width) to the newest codebooks.

        Changes code, bound and stamp (rows, parts) in place; a stamp of 255 stands for no bound yet. Returns the
        squared distances of the rows and how many of their parts were compared with all entries.
        """
        error, scans = np.zeros(len(x), np.int64), np.zeros(len(x), np.int32)
        for part, book in enumerate(self.books[-1]):
            own = x[:, part]
            distance = ((own - book[code[:, part]]) ** 2).sum(axis=1)
            left = np.full(len(x), -1.0)
            known = np.flatnonzero(stamp[:, part] != 255)
            if len(known):
                shift = np.stack([o[part] for o in self.others])[stamp[known, part], code[known, part]]
                left[known] = bound[known, part] * (1 - MARGIN) - shift * (1 + MARGIN)
            again = np.flatnonzero(~(np.sqrt(distance.astype(np.float64)) * (1 + MARGIN) < left))
            if len(again):
                scans[again] += 1
                found = squared(own[again], book)
                nearest = found.argmin(axis=1)  # the first of equals
                code[again, part] = nearest
                distance[again] = found[np.arange(len(again)), nearest]
                if len(book) > 1:
                    found[np.arange(len(again)), nearest] = np.iinfo(np.int64).max
                    bound[again, part] = np.sqrt(found.min(axis=1).astype(np.float64))
                else:
                    bound[again, part] = np.inf
                stamp[again, part] = self.now
            error += distance
        return error, scans


def _parts(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def assigned(rows: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """One assignment of all vectors to the last of `books`: code, bound, stamp (16 values each), error and scans.

    `rows` has (vec_id, label, x) before the first assignment, and the result of the one before later on.
    """
    sent = rows.sparkSession.sparkContext.broadcast(books)  # rounds x parts x entries x width numbers
    first = "code" not in rows.columns

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        history, n = History(sent.value), batch.num_rows
        x = _parts(batch.column("x"), history.books[-1].shape[2])
        if first:
            code, stamp = np.zeros((n, PARTS), np.uint8), np.full((n, PARTS), 255, np.uint8)
            bound = np.zeros((n, PARTS))
        else:
            code, stamp, bound = (np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, PARTS).copy()
                                  for name, kind in (("code", np.uint8), ("stamp", np.uint8), ("bound", np.float64)))
        error, scans = history.assign(x, code, bound, stamp)
        packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, bound, stamp)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("x"), *packed, pa.array(error), pa.array(scans)],
            ["vec_id", "label", "x", "code", "bound", "stamp", "error", "scans"])

    return map_batches(rows, work, STATE.format(label=label_type))


def moved(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after the parts of `rows` have pulled their entries to the floored means; unused entries stay.

    Each task adds up its own parts; at most one row per part and entry of each task is shuffled.
    """
    parts, entries, width = book.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            cell = (code + np.arange(parts) * entries).ravel()
            np.add.at(total, cell, _parts(batch.column("x"), width).reshape(-1, width))
            count += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            ["cell", "n", "total"])

    small_batches(rows.sparkSession)
    sums = (rows.select("code", "x").mapInArrow(totals, "cell int, n long, total array<long>")
            .select("cell", "n", F.posexplode("total").alias("at", "value"))
            .groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")))
    out = book.copy().reshape(parts * entries, width)
    for r in sums.collect():  # parts x entries x width rows
        out[r["cell"], r["at"]] = r["value"] // r["n"]
    return out.reshape(book.shape)


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, (vec_id, label, x, code, bound, stamp, error, scans), and the final codebooks.

    Vectors that are null or hold null or non-finite components are left out, and so are vectors of another length than
    the first kept one (by id): they have no place in the codebooks. A length that is no multiple of 16 is filled with
    zeros, which change no distance. The first codebook has the parts of the `entries` smallest ids in ascending order, of all vectors
    if there are fewer; equal ids are ordered by their components and null ids come last. Equal rows are all kept. An
    empty table gives an empty result. Components from 524,288 on are refused with a ValueError.
    """
    vectors = whole_vectors(table, id_col, vector_col, label_col)
    label_type = vectors.schema["label"].dataType.simpleString()
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    size = len(first[0]["x"]) if first else PARTS
    first = [r["x"] for r in first if len(r["x"]) == size]
    if len(first) < entries:  # rare: vectors of other lengths came first, or there are few vectors
        first = [r["x"] for r in vectors.where(F.size("x") == size).orderBy(F.col("vec_id").asc_nulls_last(), "x")
                 .limit(entries).select("x").collect()]
    width = -(-size // PARTS)
    fits = F.forall("x", lambda c: F.abs(c) < LARGEST)
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit(f"components must be below {LARGEST // 256}")).cast("array<double>"))
    rows = vectors.where(F.size("x") == size).withColumn(
        "x", F.concat(checked.cast("array<int>"), F.array_repeat(F.lit(0), width * PARTS - size)))
    start = np.zeros((max(1, len(first)), PARTS * width), np.int64)
    start[:len(first), :size] = np.array(first, np.float64).reshape(len(first), size)
    if np.abs(start).max(initial=0) >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // 256}")
    books = [start.reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()]
    for i in range(rounds):
        rows = stored(assigned(rows, books, label_type), f"vector-codes-{i}")
        books.append(moved(rows, books[-1]))
    return assigned(rows, books, label_type), books[-1]


def compression_report(table: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id",
                       vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code string, error, label_error, codebooks_sha256) of `compress`, whose docstring says what is kept."""
    coded, book = compress(table, rounds, entries, id_col, vector_col, label_col)
    # The last assignment is read twice: by label, and for the rows.
    coded = stored(coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes-last")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    totals = (coded.groupBy("label").agg(F.sum("error").alias("label_error"))
              .select(F.col("label").alias("of_label"), "label_error", salts.alias("of_salt")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return (salted.join(totals, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256")))


def _round_sql(i: int) -> str:
    """One assignment and the codebooks after it; a key of distance and index gives the lower index of equals."""
    mean = ", ".join(f"coalesce((s{c} - ((s{c} % m) + m) % m) // m, b.{c}) AS {c}" for c in "abcd")
    sums = ", ".join(f"CAST(sum(p.{c}) AS BIGINT) AS s{c}" for c in "abcd")
    return f"""
near{i} AS (
    SELECT p.vec_id, p.part, min((power(p.a - b.a, 2) + power(p.b - b.b, 2) + power(p.c - b.c, 2) + power(p.d - b.d, 2))::BIGINT * 64 + b.entry) AS found
    FROM parts p JOIN book{i} b ON p.part = b.part GROUP BY p.vec_id, p.part),
sums{i} AS (
    SELECT p.part, near{i}.found % 64 AS entry, count(*) AS m, {sums}
    FROM parts p JOIN near{i} ON p.vec_id = near{i}.vec_id AND p.part = near{i}.part GROUP BY ALL),
book{i + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, {mean} FROM book{i} b LEFT JOIN sums{i} s ON s.part = b.part AND s.entry = b.entry),"""


#: For vectors of 64 components and distinct ids, as in the given tables.
ORACLE_SQL = f"""
WITH whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, part, x[4 * part + 1] AS a, x[4 * part + 2] AS b, x[4 * part + 3] AS c, x[4 * part + 4] AS d
    FROM whole, range(16) r(part)),
book0 AS MATERIALIZED (
    SELECT part, entry, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts)
    WHERE entry < 64),{_round_sql(0)}{_round_sql(1)}
near2 AS (
    SELECT p.vec_id, p.part, min((power(p.a - b.a, 2) + power(p.b - b.b, 2) + power(p.c - b.c, 2) + power(p.d - b.d, 2))::BIGINT * 64 + b.entry) AS found
    FROM parts p JOIN book2 b ON p.part = b.part GROUP BY p.vec_id, p.part),
coded AS (
    SELECT vec_id, string_agg(printf('%02x', found % 64), '' ORDER BY part) AS code, CAST(sum(found // 64) AS BIGINT) AS error
    FROM near2 GROUP BY vec_id),
labelled AS (SELECT coded.*, label FROM coded JOIN whole USING (vec_id)),
books AS (
    SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM labelled, books
"""
