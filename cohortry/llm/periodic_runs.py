"""Runs of words that repeat with a period, and texts with the repeats taken out.

A run is a stretch of words with smallest period q that no neighbouring word extends, and at
least two periods and ``LEAST`` words long. By the runs theorem each one holds, under the
order of the words or under its reverse, a longest Lyndon word that starts at one of its
words and has its period. So the longest Lyndon words at all places, under both orders, are
the candidates; each is extended to the right by a longest common extension in the suffix
tree of the words and to the left by one in the suffix tree of the reversed words.

Most words of most texts can't lie in a run, and no tree is built for them: the part of a run
before its last period holds at least half of ``LEAST`` words, and recurs one period later, so
a run is covered by groups of that many words that recur within the same stretch.
:func:`stretches` cuts a text where no such group passes, until nothing more falls off.
Stretches of several texts share a pair of trees, with a separate mark after each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, texts_of
from cohortry.llm.registry import documents, query
from cohortry.llm.suffix_tree import SuffixTree

LEAST = 12
#: Words that share a pair of trees, about; one longer stretch has a pair of its own.
TOGETHER = 1 << 14
#: An odd number for rolling hashes of word groups.
BASE = 0x9E3779B97F4A7C15

RUNS = [T.StructField("runs", T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))),
    T.StructField("collapsed", T.StringType())]


def covered(hashes: np.ndarray, group: int) -> np.ndarray:
    """Which words lie in a group whose hash recurs; zero stands for no group."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = (ranked[1:] == ranked[:-1]) & (ranked[1:] != 0)
    steps = np.zeros(len(hashes) + group, np.int32)
    if same.any():
        at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        steps[at] += 1
        steps[at + group] -= 1  # places differ from each other
    return np.cumsum(steps[:-1]) > 0


def pieces(label: np.ndarray) -> list[tuple[int, int, int]]:
    """The stretches (label, start, end) of equal labels but 0."""
    edges = np.flatnonzero(np.diff(label, prepend=0, append=0))
    return [(int(label[a]), int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False) if label[a]]


def stretches(texts: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The stretches (text, start, end) outside of which no word lies in a run, in order.

    ``texts`` have numbers for words, equal for equal words. Two words with one number can make
    stretches longer, never shorter.
    """
    group = least // 2
    sizes = [len(t) for t in texts]
    ends = np.cumsum(sizes)
    words = np.concatenate([*texts, np.zeros(group, np.int64)]).astype(np.uint64)
    number = np.repeat(np.arange(1, len(texts) + 1), sizes)
    n = len(number)
    hashes = number.astype(np.uint64)
    for k in range(group):
        hashes = hashes * np.uint64(BASE) + words[k:n + k] + np.uint64(1)
        hashes ^= hashes >> np.uint64(31)
    hashes |= np.uint64(1)
    hashes[np.arange(n) + group > np.repeat(ends, sizes)] = 0
    out = []
    open_ = pieces(np.where(covered(hashes, group)[:n], number, 0)) if n else []
    open_.reverse()
    while open_:
        text, start, end = open_.pop()
        if end - start < least:
            continue
        inside = covered(hashes[start:end - group + 1], group)
        if inside.all():
            first = int(ends[text - 1]) - sizes[text - 1]
            out.append((text - 1, start - first, end - first))
            continue
        open_ += [(text, start + a, start + b) for _, a, b in reversed(pieces(inside.astype(np.int8)))]
    return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a lower rank; the number of places where there is none."""
    n = len(rank)
    after = [n] * n
    waiting: list[int] = []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            after[waiting.pop()] = i
        waiting.append(i)
    return np.array(after, np.int64)


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence as rows (start, length, period), by start, then period."""
    # With a word of its own at the end no suffix is a prefix of another, so the suffixes
    # under the reverse order of the words come in the reverse order.
    words = np.append(words, words.max(initial=0) + 1)
    n = len(words)
    ahead, back = SuffixTree(words.tolist()), SuffixTree(words[::-1].tolist())
    found, i = [], np.arange(n)
    for rank in (ahead.rank, -ahead.rank):
        j = next_smaller(rank[:n].tolist())  # the longest Lyndon word at i ends there
        p = j - i
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        here = np.flatnonzero(j < n)
        right[here] = ahead.common(i[here], j[here])
        here = np.flatnonzero((i > 0) & (j < n))
        left[here] = back.common(n - i[here], n - j[here])
        long = left + right + p >= np.maximum(2 * p, least)
        found.append(np.stack([i - left, left + right + p, p], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers from 0 on, equal for equal words."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def runs_of_all(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each list of words. Stretches of several lists share a pair of trees."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, int, list]] = []
    held = 0

    def flush() -> None:
        ids = [word_ids(words) for _, _, words in waiting]
        top = max(int(w.max()) for w in ids) + 1
        rows = runs(np.concatenate([np.append(w, top + k) for k, w in enumerate(ids)]), least)
        places = np.cumsum([0, *[len(w) + 1 for w in ids]])
        for k, part in enumerate(np.split(rows, np.searchsorted(rows[:, 0], places[1:-1]))):
            if len(part):
                text, start, _ = waiting[k]
                part[:, 0] += start - places[k]
                found[text].append(part)

    hashed = [np.fromiter(map(hash, words), np.int64, len(words)) for words in texts]
    for text, start, end in stretches(hashed, least):
        if waiting and held + end - start > TOGETHER:
            flush()
            waiting, held = [], 0
        waiting.append((text, start, texts[text][start:end]))
        held += end - start
    if waiting:
        flush()
    return [np.concatenate(parts) if parts else np.zeros((0, 3), np.int64) for parts in found]


def repeats(rows: np.ndarray, n: int) -> np.ndarray | None:
    """Which of n words a run contains after its first period; None if there are none."""
    if not len(rows):
        return None
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
    np.add.at(steps, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed``; columns of these names are replaced.

    ``runs`` has start (word number from 0), length and period of every run of the whole text,
    by start, then period. Words are separated by blanks and the characters 9 to 13. ``collapsed`` has
    the words that no run contains after its first period, joined by one space.

    Null and empty texts, and texts of white space, have no runs and an empty ``collapsed``.
    Repeated rows each have their result, an empty table stays empty. A text is held whole by
    its task; its trees and tables take some hundred bytes for each word that can lie in a run.
    """

    def compute(batch: pa.RecordBatch) -> list:
        split = [t.encode().split() for t in texts_of(batch, text)]
        found = runs_of_all(split, least)
        collapsed = []
        for words, rows in zip(split, found, strict=True):
            gone = repeats(rows, len(words))
            collapsed.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
        return [[[{"start": a, "length": b, "period": c} for a, b, c in rows.tolist()] for rows in found], collapsed]

    return add_columns(docs, RUNS, lambda: compute, [text])


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` where one in ten, told by the checksum of its id, repeats its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, words))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    planted = F.array_join(F.transform("_words", lambda w, i: F.get("_words", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def _(spark, d):
    rows = periodic_runs(with_planted_periods(documents(spark, d).select("doc_id", "text")))
    first = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("_first", first)
    length, period = F.col("_first.length"), -F.col("_first.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_first.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * _first.length DIV -_first.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
