"""Columns of the caller keep their values, whatever their names."""

import pytest
from pyspark.sql import functions as F

from cohortry.llm import (bpe, exact_dedup, jaccard_join, language_id, line_labels, packing, periodic_runs, quality_rules,
                          sharding)

NAMES = ["a.b", "_id", "_text", "_others", "_hit", "_word", "_mask", "_bits", "_sha", "_tie", "_set", "_bands", "_label", "_place",
         "_run", "_at", "_n", "_quality", "stat_n_words", "_in0", "_out0", "batch"]
TEXTS = ["one two three four five six", "one  two three four five six", None, "", "the quick brown fox " * 5, "x"]


def classify(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    return quality_rules.classify(docs, labels)


def identify(docs):
    learned = docs.sparkSession.createDataFrame([("one two", "en"), ("eins zwei", "de")], "text string, lang string")
    return language_id.identify(docs, language_id.fit(learned))


@pytest.mark.parametrize("operator", [
    bpe.encode, bpe.round_trip, jaccard_join.near_duplicates, packing.decompose, classify,
    lambda docs: line_labels.judge(docs, line_labels.no_field()), identify,
    sharding.shard_by_bytes, exact_dedup.exact_dedup, periodic_runs.periodic_runs,
], ids=["encode", "round_trip", "near_duplicates", "decompose", "classify", "judge", "identify", "shards", "exact_dedup", "runs"])
def test_any_name(spark, operator):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in NAMES])
    got = operator(docs)
    assert [c for c in got.columns if c in NAMES] == NAMES
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(range(1, len(TEXTS) + 1))
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES)


def test_other_white_space_parts_no_words(spark):
    docs = spark.createDataFrame([(1, "ok\x85ok\u00a0ok\n" * 12), (2, "\x85\n" * 12)], "doc_id long, text string")
    for r in line_labels.judge(docs, line_labels.no_field()).collect():
        assert r.n_words == 12 and r.content_share == 1.0
    assert line_labels.lines_of("ok\x85ok\n\x0b\n\x85")[1] == [1, 1]
