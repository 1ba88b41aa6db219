"""Repeated strings against a dictionary of all strings; suffix order against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry_point
from cohortry.llm import suffix_dedup, suffix_sort


def brute(rows, length=100):
    """rows: (id, text), ids distinct -> the query's rows."""
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s:s + length], (i, s)) != (i, s):
                gone[s:s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghé漢", k=rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, shorter, line = prose(60), prose(25), "= " * 300
    out = [prose(rng.randrange(80)) for _ in range(40)]
    out += [prose(rng.randrange(9)) + " " + passage + " " + prose(rng.randrange(9)) for _ in range(40)]
    out += [prose(5) + passage[rng.randrange(100):][:rng.randrange(80, 160)] + prose(30) for _ in range(40)]
    out += [shorter + prose(30) + shorter + passage, passage, passage, line, line + "x" + line, "", None, "a" * 99, "a" * 100, "a" * 101]
    out += [passage * 3, out[45], out[45] + "!", "ab" * 70, "漢" * 40, "é" * 51]
    rng.shuffle(out)
    return [(7 * k + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_query(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = texts(chunk)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry_point.queries()["op12_suffix_dedup"](spark, str(tmp_path)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_common_line_leaves_no_strings(spark, monkeypatch):
    """Spans of a hot hash meet only where the bytes around their anchor agree, so nothing is left to merge over chunks."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5)
    found = []
    plain = suffix_dedup._sorted_spans
    monkeypatch.setattr(suffix_dedup, "_sorted_spans", lambda *a: found.append(plain(*a)) or found[-1])
    rng = random.Random(6)
    prose = lambda: "".join(rng.choices("abcdefgh", k=150))
    line = "a line that is in each text, and too short to be a hundred bytes together: " + "it ends"
    rows = [(k, prose() + line + prose()) for k in range(30)]
    rows += [(30, prose()[:9] + rows[3][1][60:-9]), (31, rows[7][1][100:] + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert [(k, hashlib.sha256(got[k]).hexdigest()) for k in sorted(got)] == [(r[0], r[4]) for r in brute(rows)]
    assert found[0].filter("_string IS NULL").count() > 0 and found[0].filter("_string IS NOT NULL").count() == 0


def test_a_long_text_in_blocks(monkeypatch):
    rng = random.Random(4)
    raw = "".join(rng.choices("ab c", k=5000)).encode() + b"x" * 700
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    for a, b in zip(whole, suffix_dedup.anchors(raw), strict=True):
        assert (a == b).all()
    hashes, place, first, last = whole
    assert first[0] == 0 and last[-1] == len(raw) - 100 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place + suffix_dedup.GRAM <= first + 100)).all()


@pytest.mark.parametrize("wrong_hashes", [False, True])
def test_suffix_order(monkeypatch, wrong_hashes):
    if wrong_hashes:
        monkeypatch.setattr(suffix_sort.Prefixes, "hashes", lambda self, start, length: np.zeros(len(start), np.uint64))
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 2, 3000).astype(np.uint8)
    at = rng.integers(0, 2900, 700)
    segment = np.sort(rng.integers(0, 9, 700))
    rank = rng.permutation(700)
    order, same = suffix_sort.sort_suffixes(raw, at, segment, rank, 9)
    want = sorted(range(700), key=lambda x: (segment[x], raw[at[x]:at[x] + 9].tobytes(), rank[x]))
    assert order.tolist() == want
    keys = [(segment[x], raw[at[x]:at[x] + 9].tobytes()) for x in want]
    assert same.tolist() == [k > 0 and keys[k] == keys[k - 1] for k in range(700)]


def test_odd_tables(spark):
    a, b = "some words that are long enough " * 2, "quite another text, as long as the first one is "
    rows = [(None, a, 1, 2, 3, 4), (3, a, 1, 2, 3, 4), (3, a, 1, 2, 3, 4), (3, b, 1, 2, 3, 4), (None, b + a, 1, 2, 3, 4), (None, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int, `a.b` int, _doc int, _pieces int")
    got = suffix_dedup.suffix_dedup(docs, length=30, gram=10)
    assert got.columns == ["doc_id", "text", "a.b", "_doc", "_pieces", "removed", "kept"]
    kept = sorted((str(r.doc_id), (r.text or "").split(" ")[0], bytes(r.kept)) for r in got.collect())
    # The second half of a repeats the first; the rows without id come after all others.
    assert kept == [("3", "quite", b.encode()), ("3", "some", a[:32].encode()), ("3", "some", a[:32].encode()),
                    ("None", "", b""), ("None", "quite", b""), ("None", "some", b"")]
    assert got.filter("`a.b` = 2 AND _doc = 3 AND _pieces = 4").count() == 6
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, length=10, gram=10)
