"""Each stage against brute force on its own input, and the whole."""

import re
from collections import defaultdict

import numpy as np

import __spark_entry__ as entry_point
import corpus_pipeline as pipeline
from cohortry.llm import language_id, line_labels

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit_on_documents(docs)
    told = pipeline.keep_languages(spark, docs, DATA)
    assert told.columns == docs.columns
    want = {i for i, r in rows.items() if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5}
    assert {r.doc_id for r in told.collect()} == want

    field = line_labels.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = pipeline.keep_quality(spark, docs, DATA)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in line_labels.judge(docs, field).filter("kept").collect()}

    single = pipeline.drop_copies(spark, docs, DATA)
    by_text = defaultdict(list)
    for i, r in rows.items():
        by_text[re.sub(r"[\x20\x09-\x0d]+", " ", r.text)].append(i)
    assert single.columns == docs.columns and sorted(map(tuple, single.collect())) == sorted(tuple(rows[min(g)]) for g in by_text.values())

    apart = pipeline.drop_near_copies(spark, docs, DATA)
    sets, label = {i: shingles(r.text) for i, r in rows.items()}, {}
    for i in sorted(sets):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                a = sets[todo.pop()]
                for j, b in sets.items():
                    if j not in label and len(a & b) >= 0.8 * len(a | b):
                        label[j] = i
                        todo.append(j)
    assert apart.columns == docs.columns and sorted(map(tuple, apart.collect())) == sorted(tuple(rows[i]) for i in set(label.values()))


def test_run(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "quality rules", "exact dedup", "n-gram Jaccard join", "packing"]
    pieces = entry_point.queries()["pipeline"](spark, DATA).collect()
    assert pieces and all(np.frombuffer(r.ids, "<u4").size == r.length for r in pieces)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in pieces}
    assert not [i for i in kept if labels.get(i) == 0]
    assert len(kept) > 100


def test_odd_documents(spark):
    good = "\n".join(" ".join(f"word{(7 * i + k) % 60}" for k in range(9)) + "." for i in range(4))
    rows = [(1, good, "en", 1, None), (1, good, "en", 1, 2.0), (2, good + " end", None, 2, 1.0), (None, good.upper(), "en", 2, 1.0),
            (None, None, None, None, None), (3, "", "de", 3, 1.0), (4, "12 34", "de", 3, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id int, score double")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert set(map(str, found)) <= set(map(str, docs.collect()))
        assert stage(spark, docs.limit(0), DATA).count() == 0
    near = pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "4", "None"]
    assert pipeline.pack(spark, docs, DATA).count() >= len(rows)
