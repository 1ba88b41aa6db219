"""Runs against all pairs of place and period, trees against plain comparison."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_point
from cohortry.llm import periodic_runs
from cohortry.llm.suffix_tree import SuffixTree


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            j = i
            while j < n - q and same[j]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                piece = words[i:i + length]
                if not any(all(piece[k] == piece[k + s] for k in range(length - s)) for s in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    least = rng.choice([2, 4, 12])
    words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(120))]
    if seed % 3 == 0 and words:
        unit = words[:rng.randrange(1, 9)]
        words = words + unit * rng.randrange(2, 9) + words[::-1]
    array = np.array(words, np.int64)
    assert list(map(tuple, periodic_runs.runs(array, least).tolist())) == brute_runs(words, least)
    others = [words, words[::-1], [], words]
    got = [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of_all(others, least)]
    assert got == [brute_runs(words, least), brute_runs(words[::-1], least), [], brute_runs(words, least)]


def test_common_extensions():
    rng = random.Random(1)
    text = [rng.randrange(2) for _ in range(200)]
    tree = SuffixTree(text)
    pairs = [(i, j) for i in range(200) for j in range(200) if i != j]
    got = tree.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for (i, j), g in zip(pairs, got.tolist()):
        k = 0
        while max(i, j) + k < 200 and text[i + k] == text[j + k]:
            k += 1
        assert g == k
    assert tree.order.tolist() == sorted(range(201), key=lambda i: text[i:] + [-1])


def test_pieces_that_hold_no_run_are_not_searched():
    words = np.arange(1000)
    assert periodic_runs.stretches([words, words]) == []
    words[500:560] = np.arange(60) % 15
    assert periodic_runs.stretches([words[:0], words, words[500:570]]) == [(1, 500, 560), (2, 0, 60)]


def brute(rows):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute_runs(words)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        out.append((i, len(found), *best, best[1] * 1000 // best[2] if found else None,
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                    hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    pool = ["a", "b", "c", "dé", "e\x85e", "\xa0f", "g\x1cg"]
    texts = [None, "", " \n\t", "one", "x " * 5000, "a b " * 6, "a b " * 5 + "a", "\x0b".join("abc" * 5), " a\r\na" * 11]
    texts += [" ".join(rng.choices(pool, k=rng.randrange(100))) for _ in range(120)]
    texts += [" ".join(f"w{k}" for k in range(rng.randrange(200))) for _ in range(120)]
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (None, None), (0, None), (7, "z " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry_point.queries()["op13_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "u v " * 7, "x", 2, 3), (1, "u v " * 7, "x", 2, 3)],
                                 "doc_id long, text string, runs string, `a.b` int, _words int")
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == 2 and got[0]["a.b"] == 2 and got[0]["_words"] == 3 and got[0].collapsed == "u v"
    assert [tuple(r) for r in got[0].runs] == [(0, 14, 2)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
