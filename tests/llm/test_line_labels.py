"""Base counts and decoding against plain versions, and held-out accuracy."""

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm import line_labels, text_stats

DATA = "/root/testdata/sf0.01"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#é", "|", " ", "\n", "  ", "\t", "\x0b", "\x85x", "\x1c", " "]), max_size=60).map("".join))
def test_base_counts(text):
    assert text_stats.base_counts(text) == brute_counts(text)


def test_base_counts_of_repeats():
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert text_stats.base_counts(text) == brute_counts(text)


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        field = line_labels.Field(rng.normal(size=sum(line_labels.LEVELS)), rng.normal(size=2), rng.normal(size=(2, 2)))
        found = [[o + int(rng.integers(v)) for o, v in zip(line_labels.OFFSETS, line_labels.LEVELS, strict=True)] for _ in range(n)]

        def score(y, field=field, found=found):
            return field.first[y[0]] + sum(field.weights[f].sum() * k for f, k in zip(found, y, strict=True)) + sum(
                field.moves[a, b] for a, b in itertools.pairwise(y))
        assert tuple(field.decode(found)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_gradient():
    rng = np.random.default_rng(2)
    field = line_labels.Field(rng.normal(size=sum(line_labels.LEVELS)), rng.normal(size=2), rng.normal(size=(2, 2)))
    docs = [np.array([[o + int(rng.integers(v)) for o, v in zip(line_labels.OFFSETS, line_labels.LEVELS, strict=True)] for _ in range(n)])
            for n in (4, 2, 1)]
    labels = [rng.integers(0, 2, len(d)) for d in docs]

    def likelihood(field):
        total = 0
        for d, y in zip(docs, labels, strict=True):
            def score(y, d=d):
                return field.first[y[0]] + sum(field.weights[f].sum() * k for f, k in zip(d, y, strict=True)) + sum(
                    field.moves[a, b] for a, b in itertools.pairwise(y))
            total += score(y) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=len(d))])
        return total / sum(map(len, docs))

    slopes = line_labels._gradient(field, docs, labels)
    for part, slope in zip((field.weights, field.first, field.moves), slopes, strict=True):
        for i in list(np.ndindex(part.shape))[:12]:
            kept = part[i]
            part[i] = kept + 1e-5
            high = likelihood(field)
            part[i] = kept - 1e-5
            low = likelihood(field)
            part[i] = kept
            assert abs((high - low) / 2e-5 - slope[i]) < 1e-6


def test_quality_of_documents_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    field = line_labels.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = line_labels.judge(docs.join(labels, "doc_id"), field).filter("doc_id % 2 = 1 AND NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "\n \n", 0), (4, "good words " * 4 + "\nand more good words in one line.", 0), (4, "ok " * 3, 0),
            (5, "One sentence of eleven quite different words that is really good.\n" * 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    field = line_labels.fit(docs, labels)
    got = line_labels.judge(docs, field).collect()
    assert len(got) == len(rows)
    assert [r.kept for r in sorted(got, key=lambda r: (r.doc_id, len(r.text or "")))] == [False, False, False, False, False, True]
    assert all(r.content_share is None for r in got if r.doc_id < 4)
    assert line_labels.judge(docs.limit(0), field).count() == 0
