"""Shards against a plain search over all contiguous cuts."""

import random
import zlib
from itertools import accumulate

import pytest

from cohortry.llm import sharding


def best(sizes, shards):
    """The least possible largest sum, by dynamic programming."""
    sums = [0, *accumulate(sizes)]
    row = sums[:]
    for _ in range(shards - 1):
        row = [min(max(row[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_optimal(spark, seed):
    rng = random.Random(seed)
    n, shards = [5, 60, 200, 300][seed], [8, 5, 7, 3][seed]
    places = sorted(rng.sample(range(1 << 62), n) if seed < 3 else rng.sample(range(1 << 20), n))
    sizes = [rng.choice([1, 5, 9, 30]) for _ in range(n)]
    mean = sum(sizes) / shards
    sizes = [min(s, int(mean)) for s in sizes]
    groups = spark.createDataFrame(list(zip(places, sizes, strict=True)), "place long, size long")
    cuts = sharding.find_cuts(groups, shards, first_bits=3, more_bits=2)
    filled = [0] * shards
    for p, s in zip(places, sizes, strict=True):
        filled[sum(p >= c for c in cuts)] += s
    assert max(filled) == best(sizes, shards) and len(cuts) < shards


def test_laws(spark):
    rng = random.Random(5)
    texts = [None, "", "ä" * 100, "x" * 40_000] + ["hot text" * 20] * 400
    texts += ["w " * rng.randint(1, 60) + str(i) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string, shard int").repartition(6)
    got = sharding.shard_by_bytes(docs, 8).collect()
    assert len(got) == len(texts)
    by_text, slots, filled = {}, {}, [0] * 8
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        by_text.setdefault(t, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        filled[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and r.source == "s"
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    alone = {next(iter(by_text[t])) for t in ("x" * 40_000, "hot text" * 20)}
    rest = [f for i, f in enumerate(filled) if i not in alone]
    assert len(alone) == 2 and max(rest) - min(rest) < 2000


def test_small_tables(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (3, "a")], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 2
    assert sharding.shard_by_bytes(docs.limit(0), 4).count() == 0
    assert sharding.shard_by_bytes(docs, 1).select("shard").distinct().count() == 1
