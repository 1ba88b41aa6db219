"""Scans against comparing all shingles, in Python."""

import random

import pytest

from cohortry.llm import license_scan as scan


def brute(texts, templates, share):
    out = []
    for i, t in texts:
        w = scan.words_of(t or "")
        mine = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        for name, text in templates.items():
            v = scan.words_of(text)
            want = {tuple(v[k:k + 5]) for k in range(len(v) - 4)}
            places = [k for k, s in enumerate(mine) if s in want]
            found = len({mine[k] for k in places})
            if found and found >= share * len(want):
                out.append((i, name, found / len(want), found, places[0], places[-1] + 4))
    return sorted(out)


def test_all_notices_in_noise(spark):
    rng, rows = random.Random(3), []
    noise = [f"word{i}" for i in range(50)]
    for i in range(400):
        parts = [rng.choice(noise) for _ in range(rng.randint(0, 60))]
        if i % 3:
            v = rng.choice(list(scan.TEMPLATES.values())).split(" ")
            if i % 2:
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = v
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "MIT"), (903, "released UNDER the\nmit -- license"), (904, "x " * 30_000)]
    rows.append((905, "Released under the MIT License. " * 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = scan.license_scan(docs).select("doc_id", "license", "containment", "shingles_found", "first_word", "last_word")
    assert sorted(map(tuple, got.collect())) == brute(rows, scan.TEMPLATES, scan.SHARE)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, scan.TEMPLATES["MIT"], 1, "a")] * 2, "doc_id long, text string, license int, source string")
    got = scan.license_scan(docs).collect()
    assert [(r.doc_id, r.license, r.source) for r in got] == [(None, "MIT", "a")] * 2
    assert scan.license_scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan.license_scan(docs, {"short": "too few words"})
