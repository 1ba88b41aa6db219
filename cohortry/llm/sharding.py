"""Shards of nearly equal bytes by minimax contiguous partition, in DataFrame operations.

Rows with equal texts are one atomic group. Groups are ordered by a hash of their text,
and the ordered groups are cut into shards so that the largest shard is as small as
possible: a binary search finds the smallest capacity for which greedy filling needs no
more shards than given, and the cuts of that filling are used.

The group sizes never come to the driver. The search runs on block sums: the hash range
is cut into a fixed number of blocks, which bound the capacity from both sides; the few
blocks in which a cut can fall are split again and summed, until each holds one group.
Every round sums a number of blocks that depends on the shard count alone, and the last
gives the exact answer.

A group larger than the mean shard has a shard to itself, and the others share what
remains. There are fewer such groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from operator import add
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.arrow_rows import pack, unpacked
from cohortry.llm.registry import documents, query
from cohortry.session import staged

#: Bits of the place that number a block in the first round, and further bits in each later one.
FIRST_BITS, MORE_BITS = 14, 6
PLACE_BITS = 63
#: Rows that are numbered in one window, about.
ROWS_PER_RUN = 1000
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


class Unit(NamedTuple):
    """Consecutive groups: those whose place, without its last ``shift`` bits, is that of ``first``."""

    first: int
    shift: int
    size: int
    groups: int


def greedy_ends(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of greedily filled shards over whole units with prefix sums ``sums``.

    The last end is below ``len(sums)`` if the shards don't hold all.
    """
    ends, done, at = [], 0, 0
    for _ in range(shards):
        at = bisect_right(sums, done + capacity, at)
        ends.append(at)
        done = sums[at - 1] if at else 0
    return ends


def smallest_capacity(sums: list[int], shards: int, low: int) -> int:
    """The smallest capacity from ``low`` on for which greedy filling holds all units."""
    high = max(low, sums[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(sums, middle, shards)[-1] == len(sums):
            high = middle
        else:
            low = middle + 1
    return low


def find_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> list[int]:
    """The places at which shards 1, 2, ... begin, for ``groups`` of ``place`` and ``size`` with distinct places.

    No group may be larger than the mean shard. A shard that begins behind all groups has no
    entry, so the list may be shorter than ``shards - 1``.
    """
    def summed(rows: DataFrame, shift: int) -> list[Unit]:
        found = rows.groupBy(F.shiftright("place", shift).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        return [Unit(r.b << shift, shift, r.s, r.n) for r in found.collect()]

    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return []
    units = sorted(summed(groups, PLACE_BITS - first_bits))
    while True:
        sums = list(accumulate(u.size for u in units))
        low = max(-(-sums[-1] // shards), largest)
        stuck = {i for i, u in enumerate(units) if u.size > low}  # at most ``shards`` of them
        if stuck:
            chosen = stuck
        else:
            # The answer lies between low and high; so each cut lies between those of greedy
            # filling with whole units to low, and of shards cut anywhere at high.
            high = smallest_capacity(sums, shards, low)
            early = greedy_ends(sums, low, shards - 1)
            chosen = {i for k, a in enumerate(early, 1) for i in range(a, bisect_right(sums, k * high) + 1)
                      if i < len(units) and units[i].groups > 1}
            if not chosen:
                ends = greedy_ends(sums, smallest_capacity(sums, shards, low), shards - 1)
                return [units[e].first for e in ends if e < len(units)]
        finer = []
        for shift in {units[i].shift for i in chosen}:
            blocks = [(units[i].first >> shift,) for i in sorted(chosen) if units[i].shift == shift]
            # Their number depends on the shard count alone.
            wanted = F.broadcast(groups.sparkSession.createDataFrame(blocks, "_block long"))
            inside = groups.join(wanted, F.shiftright("place", shift) == F.col("_block"))
            finer += summed(inside, max(0, shift - more_bits))
        units = sorted([u for i, u in enumerate(units) if i not in chosen] + finer)


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the UTF-8 bytes of the text and 8; null counts as no bytes. Rows with equal
    texts, null and empty alike, share a shard. Slots count from 0 without gaps in each
    shard, over a hash of the ids, so that no group of equal texts or ids meets in one
    task; repeated rows get slots of their own. An empty table stays empty; with fewer groups than
    shards some shards are empty. Columns of ``docs`` with a name of the result are replaced, all other
    names are free. A text of any length is one row; longer than the mean shard, its group has one to itself.
    """
    clean = F.coalesce(F.col("_text"), F.lit(""))
    rows = staged(pack(docs, doc_id, text, RESULT).select(
        "_id", "_others", (F.octet_length(clean) + 8).cast("long").alias("size"), F.crc32(clean.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(clean), 1).alias("_place")), "rows")
    groups = staged(rows.groupBy(F.col("_place").alias("place")).agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")

    total, n = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    alone, left = [], shards
    for r in groups.orderBy(F.desc("size"), "place").limit(shards).collect():
        if r.size * left <= total:
            break
        alone.append(r.place)
        total, left = total - r.size, left - 1
    shared = groups.filter(~F.col("place").isin(alone)) if alone else groups
    cuts = find_cuts(shared.select("place", "size"), left) if left else []

    shard = reduce(add, [(F.col("_place") >= cut).cast("int") for cut in cuts], F.lit(0))
    for k, place in enumerate(alone):
        shard = F.when(F.col("_place") == place, left + k).otherwise(shard)
    runs = max(1, n // (shards * ROWS_PER_RUN))
    placed = rows.withColumns({"shard": shard, "_run": F.pmod(F.xxhash64("_id", "_place", "_others"), F.lit(runs))})
    counts = placed.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_run").orderBy("_id", "_place", F.xxhash64("_others"))
    numbered = placed.withColumn("_at", F.row_number().over(inside)).join(starts, ["shard", "_run"])
    return numbered.select(
        *unpacked(docs, doc_id, text, RESULT), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op9_minimax_shards")
def _(spark, d):
    return shard_by_bytes(documents(spark, d).select("doc_id", "text"))
