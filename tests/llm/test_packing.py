"""Pieces put together again give the ids of the library; every piece is a power of two."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortry.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_lengths(n):
    got = packing.piece_lengths(n, 1024)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got)
    assert len(got) == n // 1024 + (n % 1024).bit_count() and got == sorted(got, reverse=True)


def test_round_trip(spark, tmp_path):
    texts = [None, "", "one two", "one two", "words and\n\n lines " * 3000]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, offset int").repartition(3)
    pieces = packing.decompose(docs)
    assert "text" not in pieces.columns
    got = pieces.collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == ids
        assert {r.doc_tokens for r in mine} == {len(ids)} and {r.source for r in mine} == {"x"}
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(a <= r.sequence_id < b for r in got for a, b in [packing.bucket_range(r.length)])
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert back.count() == len(got)
    assert packing.decompose(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(docs, longest=1000)


def test_query(spark):
    from cohortry.llm import registry
    registry.load()
    rows = registry.QUERIES["op3_binary_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        if r.doc_id % 10 == 0:
            ids = np.array(LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert {r.doc_id for r in rows} == set(texts)
