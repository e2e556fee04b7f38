from __future__ import annotations

import hashlib
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from logtide.llm.byte_bpe import ROW_LEAVES, ByteCodec, PairTable, encode_documents, encoding_digests, merge, merge_rows, read_ranks, unpacked
from logtide.llm.queries import tokenizer_file

TABLE, PATTERN = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
OWN = ByteCodec(TABLE, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(TABLE), special_tokens={})


def own(text: str) -> list[int]:
    return unpacked(OWN.encode(text)).tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r　\x1c'stabet.,é日🎉 ")), max_size=60))
def test_same_ids_and_bytes_as_the_library(text):
    ids = own(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode() == LIBRARY.decode_bytes(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", "a" * 30_000, "ab" * 20_000, " " * 999, "\n\n\nx", "\n", "a\t \n b ", "日本" * 3_000,
                                  "x\n\n y\r\n", "of the." * 9_000, "!?" * 9_999, "we'll they're 's 'S", "12345 678 ½²"])
def test_long_and_odd_texts(text):
    assert own(text) == LIBRARY.encode_ordinary(text)


def test_every_character_is_cut_as_by_the_library():
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1_000):
        for gap in ("", "x"):
            text = gap.join(points[at:at + 1_000])
            assert own(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab .é\n", max_size=40), max_size=8))
def test_texts_together_as_alone(texts):
    assert [unpacked(x).tolist() for x in ByteCodec(TABLE, PATTERN).encode_all(texts)] == list(map(LIBRARY.encode_ordinary, texts))


def plain(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges one by one over a list."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=4), max_size=25, unique=True), st.text("abc", max_size=40))
def test_merges_of_any_ranks(tokens, text):
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    raw, expected = text.encode(), plain(text.encode(), ranks)
    assert merge(raw, ranks, max(map(len, ranks))) == expected
    if len(raw) > 1:
        leaves, byte_ids = next(n for n in ROW_LEAVES if len(raw) <= n + 1), np.arange(256)
        rows = merge_rows([raw, raw[:2], raw], leaves, PairTable(ranks), byte_ids)
        assert [unpacked(r).tolist() for r in rows] == [expected, plain(raw[:2], ranks), expected]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=20))
def test_decodes_any_ids_as_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode_bytes(ids)


def test_unknown_ids_and_incomplete_tables_are_refused():
    with pytest.raises(KeyError):
        OWN.decode([50_256])
    with pytest.raises(ValueError):
        ByteCodec(b"YQ== 0\n", PATTERN)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in encoding_digests(docs, TABLE, PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_null_empty_repeated_and_extra_columns(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "to it"), (3, "to it"), (None, "a")], ids="x", decoded="y")
    rows = sorted((r.doc_id or 0, tuple(r.ids), bytes(r.decoded)) for r in encode_documents(docs, TABLE, PATTERN).collect())
    it = tuple(LIBRARY.encode_ordinary("to it"))
    assert rows == [(0, tuple(LIBRARY.encode_ordinary("a")), b"a"), (1, (), b""), (2, (), b""), (3, it, b"to it"), (3, it, b"to it")]
    assert encode_documents(docs.limit(0), TABLE, PATTERN).collect() == []
