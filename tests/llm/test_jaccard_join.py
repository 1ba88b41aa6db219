"""Near copies against comparing all pairs in Python."""

import random

import numpy as np
import pytest

from cohortry.llm import jaccard_join as join
from cohortry.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [frozenset(shingles(t)) for _, t in rows]
    distinct = sorted(set(sets), key=lambda s: sorted(s))
    similar = {s: {o for o in distinct if o != s and s and o and len(s & o) >= 0.8 * len(s | o) - 1e-9} for s in distinct}
    label, out = {}, []
    for s in distinct:
        if s not in label:
            todo, label[s] = [s], s
            while todo:
                for o in similar[todo.pop()]:
                    if o not in label:
                        label[o] = s
                        todo.append(o)
    for (i, _), s in zip(rows, sets, strict=True):
        if not s:
            out.append((i, i, 0, 1))
            continue
        out.append((i, min(j for (j, _), o in zip(rows, sets, strict=True) if o and label[o] == label[s]),
                    len(similar[s]), sets.count(s)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "one two", "one two", "One TWO", "a b c d e", " ".join(["x"] * 9)]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 12)):
            w = base[:]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(400)}"
            texts.append(" ".join(w))
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [256, 3])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    rows = corpus(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_linked_matches_sets(monkeypatch):
    monkeypatch.setattr(join, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(100, 200, 2).astype(np.uint64)])) for _ in range(20)]
    plain = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets]
    got = {i: n for i, n, _ in join.linked(sets, 0, 0.8)}
    assert got == {i: sum(r) - 1 for i, r in enumerate(plain) if sum(r) > 1}
    got = {i: n for i, n, _ in join.linked(sets, 8, 0.8)}
    want = {i: sum(plain[i][8:]) if i < 8 else sum(plain[i][:8]) for i in range(20)}
    assert got == {i: n for i, n in want.items() if n}


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (3, 9), (5, 5), (50, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3, 50: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, 1, "s"), (5, text, 1, "s"), (5, text, 1, "s"), (5, "another text", 1, "s"), (None, None, 1, "s"),
            (None, "only null ids here", 1, "s"), (8, text + " end", 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, source string")
    got = join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    near = [r for r in got if r.n_links]
    assert len(near) == 4 and {r.class_id for r in near} == {5} and {r.n_copies for r in near} == {1, 3}
    assert join.near_duplicates(docs.limit(0)).count() == 0
