"""Exact duplicates against a plain grouping in Python."""

import hashlib
import re

import pytest

from cohortry.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        text = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        ids = [x for x in groups[text] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("words", [16, 1 << 20])
def test_groups(spark, words):
    texts = ["a b", "a  b", "a\tb", "a b", None, "", " ", "\n", "c", "d", "e" * 50_000, "e" * 50_000, "A b"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(1000 + i, f"text {i}") for i in range(300)]
    rows += [(2000 + i, "hot  text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(docs, max_words=words).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    rows = [(1, "x", "b", 5), (1, "x", "a", 5), (None, "x", "a", 5), (None, "y", "a", 5), (None, "y", "a", 5), (7, "z", "q", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, keep_id int")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 6
    kept = [r for r in got if r.kept]
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "None"]
    assert {r.group_size for r in got if r.text == "x"} == {3} and {r.keep_id for r in got if r.text == "y"} == {None}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_only_possible_copies_shuffle(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', least(id, 1900)) AS text")
    bits, words = exact_dedup.repeated_filter(docs, "text", 1 << 20)
    assert words >= 1024 and bits.count() == 1
