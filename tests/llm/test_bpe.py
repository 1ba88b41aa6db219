"""Encoding against the tokenizers library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from cohortry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN, ENCODE = bpe.own_encoder(bpe.vocabulary_text(PATH))
OTHER = bpe.library_encoder(bpe.vocabulary_text(PATH))
PARTS = st.sampled_from([*"ab .,'!\n\t\r\0é漢9 　\x1c\x85", "  ", "<|endoftext|>", "'ve", " the", "😀"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_any_text_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == want
    assert np.frombuffer(OTHER(text), "<u4").tolist() == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(OWN.stretch, OWN.special)
    text = "some words again and again, some words\nand others " * 20
    assert small(text) == ENCODE(text)


def test_long_word_without_spaces():
    text = "abcdefghij" * 3000
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 3])
def test_frames(spark, parts):
    texts = [None, "", "a b", "a b", "Über\n\n\tx  y <|endoftext|> z ", "w " * 5000]
    rows = [(i, t, "kept", 7.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double").repartition(parts)
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert out[i].decoded == (t or "") and out[i].text == t
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "k long, ids array<int>")
    assert bpe.decode(nothing).first().decoded == ""


def test_query_gives_what_the_library_gives(spark, tmp_path):
    texts = [None, "", "a b", "Über\n\n\tx  y <|endoftext|> z ", "w " * 3000, "\0 \x85 \xa0", "漢字" * 40, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry_point.queries()["op1_bpe_round_trip"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, `a.b` int, _others int, _in0 int")
    row = bpe.round_trip(bpe.decode(bpe.encode(docs))).first()
    assert (row["a.b"], row._others, row._in0, row.decoded, row.n_tokens) == (1, 2, 3, "a b", 2)
