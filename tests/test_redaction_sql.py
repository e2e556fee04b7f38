"""Redaction of documents against its SQL on texts that the given tables do not have."""

from __future__ import annotations

import random

import duckdb

from logtide.catalog import context as c

PIECES = [
    "555-123-4567", "(800) 123-4567", "+1 415.555.0100", "4111 1111 1111 1111", "378282246310005", "3782 822463 10005",
    "a.b+c@mail.example.org", "x@y.co", "10.0.0.7", "2001:db8:0:0:0:0:0:1", "fe80::1", "a::", "12:30:45", "[EMAIL REDACTED]",
    "[IPv4 REDACTED]", "é", "ß", "１２３", "٣", "日本", "‍", "é", " ", "\x85", "\x0b", "\n", "\t", " ", ",", ".", "_",
    "-", "x", "9", "(", "+", "::", "%"]
ODD = [None, "", "555-123-4567 555-123-4567", "x@y.coß", "[CC REDACTED]", "call 555-123-4567\n", "4111\x0b1111\x0b1111\x0b1111"]


def test_documents_like_sql(spark, tmp_path):
    """Missing texts, labels beforehand, letters and digits of other scripts beside a match, phone numbers side by side."""
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, 7))) for _ in range(4_000)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    theirs = {d: (clean, n) for d, clean, n in con.execute(c.ORACLE["R1_redact_documents"]).fetchall()}
    mine = {r.doc_id: (r.clean_md5, r.n) for r in c.scrubbed_documents(spark, str(tmp_path)).collect()}
    assert {i: (texts[i], theirs[i], mine[i]) for i in theirs if mine[i] != theirs[i]} == {}
