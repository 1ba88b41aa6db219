"""Naive Bayes against a plain computation, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import language_id, registry

DATA = "/root/testdata/sf0.01"


def test_blocks_count_every_ngram_once(monkeypatch):
    text = "Some text, längere Wörter 漢字 " * 30
    whole = Counter(np.concatenate(list(language_id.blocks(text))).tolist())
    assert sum(whole.values()) == sum(len(text) + 2 - n + 1 for n in language_id.ORDERS)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language_id, "BLOCK", size)
        assert Counter(np.concatenate(list(language_id.blocks(text))).tolist()) == whole


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    rows = docs.collect()
    model = language_id.fit(docs)
    counts, seen = defaultdict(Counter), Counter()
    for r in rows:
        seen[r.lang] += 1
        for found in language_id.blocks(r.text):
            counts[r.lang].update(found.tolist())
    assert model.languages == sorted(counts)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in rows[:60]:
        best = {}
        for name in counts:
            total = sum(counts[name].values()) + language_id.SMOOTHING * language_id.BUCKETS
            best[name] = math.log(seen[name] / len(rows)) + sum(
                math.log((counts[name][b] + language_id.SMOOTHING) / total)
                for found in language_id.blocks(r.text) for b in found.tolist())
        name = max(best, key=best.get)
        assert got[r.doc_id].lang_pred == name
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - best[name]) for v in best.values()), abs=0.02)


def test_held_out_accuracy(spark):
    registry.load()
    rows = registry.QUERIES["op8_language_id"](spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(out) > 100
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97


def test_odd_rows(spark):
    rows = [(1, "hello there", "en", 1), (2, None, "en", 1), (3, "guten tag", None, 1), (4, "", "de", 1), (5, "12 !?", "en", 1),
            (6, "guten abend zusammen", "de", 1), (6, "guten abend zusammen", "de", 1), (7, "x" * 600_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2, 4, 5))
    assert by_id[3].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
