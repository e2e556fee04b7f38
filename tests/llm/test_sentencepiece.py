from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from logtide.llm.queries import tokenizer_file
from logtide.llm.sentencepiece_bpe import PieceCodec, encode_documents, encoding_digests

MODEL = tokenizer_file()
OWN = PieceCodec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n▁abet.,é日🎉\x00 ")), max_size=60))
def test_same_ids_and_text_as_the_library(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262), st.sampled_from([0, 1, 2, 259, 28705])), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", "a" * 5_000, "ab" * 20_000, " " * 999, "▁▁ ▁", "日本" * 3_000, "x\n\n y\r\n", "of the." * 9_000])
def test_long_and_odd_texts(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text) and OWN.decode(ids) == LIBRARY.decode(ids)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in encoding_digests(docs, MODEL).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_null_empty_repeated_and_extra_columns(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "to it"), (3, "to it"), (None, "a")], ids="x", decoded="y")
    rows = sorted((r.doc_id or 0, tuple(r.ids), r.decoded) for r in encode_documents(docs, MODEL).collect())
    it = tuple(LIBRARY.encode("to it"))
    assert rows == [(0, tuple(LIBRARY.encode("a")), "a"), (1, (), ""), (2, (), ""), (3, it, "to it"), (3, it, "to it")]
    assert encode_documents(docs.limit(0), MODEL).collect() == []


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as layout

    proto = layout.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = layout.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        PieceCodec(proto.SerializeToString())
