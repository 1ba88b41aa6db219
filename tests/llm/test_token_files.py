"""Exact round trips of the file format, and against the tokenizers library."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm import registry, token_files
from cohortry.session import new_folder

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
IDS = st.lists(st.integers(0, 2**32 - 1), max_size=40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 2**60), IDS), max_size=8), st.sampled_from(["byte", "bit"]),
       st.integers(1, 9))
def test_file_round_trip(docs, kind, block):
    out = io.BytesIO()
    writer = token_files.Writer(out, kind, block)
    for d, ids in docs:
        writer.add(d, np.array(ids, "<u4").tobytes())
    writer.close()
    reader = token_files.Reader(out)
    got = list(reader.documents())
    assert [(d, np.frombuffer(b, "<u4").tolist()) for d, _, b in got] == docs
    assert [at for _, at, _ in got] == np.cumsum([0, *[len(i) for _, i in docs]])[:-1].tolist()


def test_damage_is_noticed():
    out = io.BytesIO()
    writer = token_files.Writer(out)
    writer.add(1, np.arange(1000, dtype="<u4").tobytes())
    writer.close()
    raw = out.getvalue()
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(raw[:-1] + b"?"))
    reader = token_files.Reader(io.BytesIO(raw))
    reader.blocks = reader.blocks.copy()
    reader.blocks["crc32"] += 1
    with pytest.raises(ValueError):
        reader.block(0)


def test_frames(spark):
    texts = {5: None, 2: "", 9: "a b", None: "null id", 3: "a b", 1: "long words here " * 4000}
    rows = [(i, t, "x", 1.0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start double").repartition(4)
    for planes in ("byte", "bit"):
        manifest = token_files.write(docs, new_folder(spark, "test"), planes=planes, block=1000)
        got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 9]
        at = 0
        for r in got:
            ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.start == at
            at += len(ids)
    empty = token_files.write(docs.limit(0), new_folder(spark, "test"))
    assert token_files.read(empty).count() == 0
    twice = token_files.write(docs.union(docs), new_folder(spark, "test"))
    assert token_files.read(twice).count() == 2 * len(texts)


def test_query(spark):
    registry.load()
    rows = registry.QUERIES["op5_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = np.array(LIBRARY.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
