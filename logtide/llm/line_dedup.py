"""Operator 4: removal of repeated passages by overlapping windows of three lines.

Lines are the parts of a text between line feeds; lines of white space only are skipped when windows are formed and
are always kept. A window is three consecutive lines that are left. All windows of all documents are compared by a
128-bit hash; of equal windows the first in (doc_id, position) stays, and every line that a later one covers is
removed. Overlapping windows thus merge into maximal removed runs.

Three lines do not see a passage of one or two. With `long_words` (the pipeline; `op4_line_dedup` keeps to its SQL) two
kinds of shorter windows take part: one or two consecutive lines that together have more than that many words, and a text
of one or two filled lines as a whole. Windows are equal only if they have the same number of lines.

Two shuffles move hashes and positions only (the first combined on the map side, so that a passage that very many
documents share arrives once per task); one shuffle brings the positions to the texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from logtide.llm.common import small_batches

WINDOW = 3
#: Words above which a passage counts, whatever the number of its lines.
LONG_WORDS = 50
FILLED = re.compile(r"[^\x20\x09-\x0D]")
CLEANED = "kept string, n_lines long, n_removed long, n_spans long"


def clean_lines(text: str | None, starts: list[int] | None, window: int = WINDOW) -> tuple[str | None, int, int, int]:
    """(text without the covered lines, lines that are not blank, removed lines, removed runs).

    `starts` numbers the windows to remove by their first line, counted from 0 among the lines that are not blank.
    """
    lines = (text or "").split("\n")
    filled = [i for i, line in enumerate(lines) if FILLED.search(line)]
    if starts is None or not len(starts):
        return text, len(filled), 0, 0
    covered = sorted({k + d for k in starts for d in range(window)})
    runs = sum(1 for i, k in enumerate(covered) if not i or covered[i - 1] != k - 1)
    gone = {filled[k] for k in covered}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(filled), len(covered), runs


def _windows(keyed: DataFrame, window: int) -> DataFrame:
    """(id, version, k, h1, h2): hashes of all windows of all rows."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(F.array().cast("array<int>"))

    def hashed(k):
        parts = [F.element_at("lines", k + 1 + d) for d in range(window)]
        return F.struct(k.alias("k"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(window), *reversed(parts)).alias("h2"))

    return (keyed.where("text IS NOT NULL").select("id", "version", lines.alias("lines"))
            .select("id", "version", F.explode(F.transform(starts, hashed)).alias("w")).select("id", "version", "w.*"))


def _short_windows(keyed: DataFrame, window: int, long_words: int) -> DataFrame:
    """(id, version, k, size, h1, h2): runs of fewer than `window` lines that are long or the whole text."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.transform("lines", lambda line: F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda word: word != "")))

    def sizes(k):
        """Lengths of the runs from k that take part."""
        count, found = F.lit(0), []
        for n in range(1, window):
            count = count + F.coalesce(F.get("words", k + n - 1), F.lit(0))
            ends = k + n <= F.size("lines")
            found.append(F.when(ends & ((count > long_words) | ((k == 0) & (F.size("lines") == n))), n))
        return F.array_compact(F.array(*found))

    starts = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda k: F.transform(sizes(k), lambda n: F.struct(k.alias("k"), n.alias("size")))))
    part = F.slice("lines", F.col("w.k") + 1, F.col("w.size"))
    return (keyed.where("text IS NOT NULL").select("id", "version", lines.alias("lines")).withColumn("words", words)
            .select("id", "version", "lines", F.explode(runs).alias("w"))
            .select("id", "version", "w.k", "w.size", F.xxhash64("w.size", part).alias("h1"),
                    F.xxhash64(F.lit(-1), F.reverse(part), "w.size").alias("h2")))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  long_words: int | None = None) -> DataFrame:
    """(id, version, starts): for each text the windows that repeat an earlier one. `version` is a hash of the text.

    With `long_words`, `starts` are all lines that such windows cover.
    """
    keyed = _keyed(docs, id_col, text_col).select("id", "version", "text")
    windows = _windows(keyed, window)
    if long_words is not None:
        windows = windows.withColumn("size", F.lit(window)).unionByName(_short_windows(keyed, window, long_words))
    place = F.struct(F.col("id").isNotNull().alias("has_id"), "id", "version", "k")
    repeated = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .where("n > 1").select("h1", "h2", "first"))
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    if long_words is not None:
        later = later.withColumn("k", F.explode(F.sequence("k", F.col("k") + F.col("size") - 1)))
    return later.groupBy("id", "version").agg(F.collect_set("k").alias("starts"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns as one, beside the two that are used: no name can clash."""
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"),
                       text.alias("text"), F.xxhash64(text).alias("version"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """(row, kept, n_lines, n_removed, n_spans): all columns of each row as `row`, and what is left of its text.

    Null ids come before all others. Rows with equal id and text count as one document and get the same result;
    different texts under one id are ordered by a hash of the text. A null text has no lines and stays null. Texts of
    fewer than `window` lines stay whole, unless `long_words` is given. An empty table gives an empty result.
    """
    covers = window if long_words is None else 1

    @pandas_udf(CLEANED)
    def cleaned(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean_lines(t, s, covers) for t, s in zip(texts, starts)],
                            columns=["kept", "n_lines", "n_removed", "n_spans"])

    # A filter on the counts would otherwise be pushed below and clean each text a second time, in a Python worker of its own.
    cleaned = cleaned.asNondeterministic()
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    found = later_windows(docs, id_col, text_col, window, long_words).withColumnsRenamed({"id": "at_id", "version": "at_version"})
    joined = rows.join(found, rows["id"].eqNullSafe(found["at_id"]) & (rows["version"] == found["at_version"]), "left")
    return joined.select("row", cleaned("text", "starts").alias("c")).select("row", "c.*")


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_spans, kept_sha256): lines that are not blank, removed ones, their runs."""
    done = remove_repeated_lines(docs.select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", "n_spans",
                       F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines removed; one that loses its last line goes as a whole.

    One or two lines count as a passage if they are long or the whole text. All columns stay; `n_chars`, where there is
    one, counts the new text.
    """
    done = remove_repeated_lines(docs, long_words=LONG_WORDS).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
           if "n_chars" in docs.columns else None}
    return done.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
filled AS (
  SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS t
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS r FROM windows WHERE t IS NOT NULL)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) v(d)),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> k - 1) AS n_spans
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS text
  FROM lines l LEFT JOIN filled f ON f.doc_id = l.doc_id AND f.n = l.n LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k
  WHERE g.k IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(r.n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
