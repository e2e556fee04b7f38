"""Operator 9: benchmark decontamination by winnowing.

Documents and benchmark items are sequences of words. In every stretch of `WINDOW - GRAM + 1` grams of `GRAM` words the
smallest hash is kept, so two texts that share `WINDOW` consecutive words share a kept gram. Kept grams of documents
are matched with those of the items; around each match the windows that contain the gram are extended to full length and
compared with the windows of the items. An item of fewer words is one window; all grams of its length are compared.

Items are brought to the documents by an equality join. Spark broadcasts the item side only while it measures it as small;
a large benchmark is joined by a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logtide.llm.common import BoundedTable, map_batches, mix64, stored, text_bytes

WINDOW, GRAM = 10, 5
#: Everything but 0-9, a-z and non-ASCII separates words; A-Z become a-z.
SEPARATE = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b
                 if chr(b) in string.digits + string.ascii_lowercase or b >= 0x80 else 0x20 for b in range(256))
#: Odd multipliers of the two hashes of a sequence of words.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SEPARATE).split()


def word_table() -> BoundedTable:
    return BoundedTable(xxhash.xxh64_intdigest, 100_000)


def hashed(words: Sequence[bytes], table: BoundedTable) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def rolling(values: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hash of every run of `size` values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for d in range(size if n > 0 else 0):
        out = out * factor + values[d:d + n]
    return mix64(out)


def winnowed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams kept: every one that is smallest in some stretch."""
    grams = rolling(values, GRAM, FIRST)
    width = WINDOW - GRAM + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for d in range(1, width):
        np.minimum(least, grams[d:d + n], out=least)
    kept = np.zeros(len(grams), bool)
    for d in range(width):
        kept[d:d + n] |= grams[d:d + n] == least
    at = np.flatnonzero(kept)
    return at, grams[at]


def item_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (size, h1, h2, item_id) and kept grams (size, gram) of the items, without repeats."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, ids, sizes, h1, h2, grams = word_table(), [], [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            values = hashed(split_words(text), table)
            if not len(values):
                continue
            size = min(WINDOW, len(values))
            first, second = rolling(values, size, FIRST), rolling(values, size, SECOND)
            ids += [item] * len(first)
            sizes += [size] * len(first)
            h1 += first.view(np.int64).tolist()
            h2 += second.view(np.int64).tolist()
            own = winnowed(values)[1] if size == WINDOW else first
            grams.append(([size] * len(own), own.view(np.int64).tolist()))
            grams[-1] = list(zip(*grams[-1]))
        kept = [g for own in grams for g in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids + [None] * len(kept), pa.string()), pa.array(sizes + [g[0] for g in kept], pa.int32()),
             pa.array(h1 + [g[1] for g in kept], pa.int64()), pa.array(h2 + [None] * len(kept), pa.int64()),
             pa.array([False] * len(ids) + [True] * len(kept))], ["item_id", "size", "h1", "h2", "is_gram"])

    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = stored(map_batches(texts, work, "item_id string, size int, h1 long, h2 long, is_gram boolean"), "benchmark")
    windows = rows.where("NOT is_gram").select("size", "h1", "h2", "item_id").distinct()
    return windows, rows.where("is_gram").select("size", F.col("h1").alias("gram")).distinct()


def _document_grams(rows: DataFrame, short: Sequence[int]) -> DataFrame:
    """(id, version, size, gram, at): winnowed grams, and all grams of the lengths in `short`."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, parts = word_table(), []
        for row, text in enumerate(text_bytes(batch.column(2))):
            values = hashed(split_words(text), table)
            parts.append((row, WINDOW, *winnowed(values)))
            for size in short:
                own = rolling(values, size, FIRST)
                parts.append((row, size, np.arange(len(own)), own))
        if not parts:
            return
        counts = [len(p[2]) for p in parts]
        row = pa.array(np.repeat([p[0] for p in parts], counts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat([p[1] for p in parts], counts).astype(np.int32)),
             pa.array(np.concatenate([p[3] for p in parts]).view(np.int64)), pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32))],
            ["id", "version", "size", "gram", "at"])

    return map_batches(rows.select("id", "version", "text"), work, "id long, version long, size int, gram long, at int")


def _extended(rows: DataFrame) -> DataFrame:
    """(id, version, n_words, windows): the windows around the matched grams (`near`, array of size and position)."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, counts, out = word_table(), [], []
        for text, near in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist()):
            words = split_words(text)
            counts.append(len(words))
            found: list[dict] = []
            if near:
                values = hashed(words, table)
                for size in sorted({x["size"] for x in near}):
                    back = WINDOW - GRAM if size == WINDOW else 0
                    starts = sorted({s for x in near if x["size"] == size
                                     for s in range(max(0, x["at"] - back), min(x["at"], len(words) - size) + 1)})
                    first, second = (rolling(values, size, f)[starts].view(np.int64).tolist() for f in (FIRST, SECOND))
                    found += [{"size": size, "start": s, "h1": a, "h2": b} for s, a, b in zip(starts, first, second)]
            out.append(found)
        kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(out, kind)],
                                         ["id", "version", "n_words", "windows"])

    return map_batches(rows.select("id", "version", "text", "near"), work,
                       "id long, version long, n_words long, windows array<struct<size int, start int, h1 long, h2 long>>")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, version, n_words, n_hit, n_items, items_sha256) of every document; `version` is a hash of its text.

    A word is hit if it lies in an occurrence of an item's window. Null texts have no words, null item texts no window;
    windows of items without an id count as hits but name no item. There is one row per row of `docs`, repeated ones
    included; ids may be null. Both tables may be empty.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    windows, grams = item_tables(items)
    short = [r["size"] for r in grams.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # nine at most
    near = (_document_grams(rows, sorted(short)).join(grams, ["size", "gram"], "left_semi")
            .groupBy("id", "version").agg(F.collect_set(F.struct("size", "at")).alias("near"))
            .withColumnsRenamed({"id": "at_id", "version": "at_version"}))
    at = rows["id"].eqNullSafe(near["at_id"]) & (rows["version"] == near["at_version"])
    read = stored(_extended(rows.join(near, at, "left")), "decontaminate")
    found = (read.where(F.size("windows") > 0).select("id", "version", F.explode("windows").alias("w")).select("id", "version", "w.*")
             .distinct())
    hits = (found.join(windows.select("size", "h1", "h2").distinct(), ["size", "h1", "h2"], "left_semi")
            .groupBy("id", "version").agg(F.collect_list(F.expr("sequence(start, start + size - 1)")).alias("runs"))
            .select("id", "version", F.size(F.array_distinct(F.flatten("runs"))).cast("long").alias("n_hit")))
    named = (found.join(windows.where("item_id IS NOT NULL"), ["size", "h1", "h2"])
             .groupBy("id", "version").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    out = read.select("id", "version", "n_words")
    for more in (hits, named):
        more = more.withColumnsRenamed({"id": "at_id", "version": "at_version"})
        out = out.join(more, out["id"].eqNullSafe(more["at_id"]) & (out["version"] == more["at_version"]), "left").drop("at_id", "at_version")
    return out.select("id", "version", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return contamination(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns, whatever their names; repeated rows stay or go together."""
    bad = contamination(docs, items).where("n_hit > 0").select(F.col("id").alias("bad_id"), F.col("version").alias("bad_version"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.col("text").cast("string")).alias("version"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("version") == F.col("bad_version"))
    return rows.join(bad, same, "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
         array_to_string(words[k : k + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, size, array_to_string(words[k : k + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, sizes WHERE len(words) >= size)),
found AS (SELECT doc_id, k, x.size, item_id FROM doc_windows x JOIN item_windows i ON x.w = i.w AND x.size = i.size),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
