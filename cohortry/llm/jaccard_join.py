"""Near-duplicate join: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Signatures. One pass makes, for every text, a hash of its whole shingle set and
   ``BANDS`` band hashes of ``ROWS`` MinHash values each. Texts with equal sets form a class
   and go on as one, so copies are never expanded.
2. Candidates. Classes shuffle on their band hashes. In a bucket every class is linked with
   the smallest class only, a number of links that grows with the bucket, not with its
   square. The connected components of these links are the candidate clusters: any two
   classes that share a bucket are in one cluster.
3. Verification. Only classes in a cluster fetch their full shingle sets. A cluster is cut
   into blocks of at most ``BLOCK`` classes, and every pair of blocks is one group, so a huge
   cluster spreads over many tasks. In a group all pairs of classes are compared exactly, by
   products of 0/1 matrices; no pairs are emitted. Each class gets its number of links, and
   the smallest class it is connected with inside the group.
4. Classes of near copies are the connected components of the verified links.

The band settings reach the target recall: two texts at the threshold meet in a bucket with
probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9998. They need not even meet: sharing a cluster
is enough. Sets hold 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, pack, slices, texts_of, unpacked
from cohortry.llm.components import components
from cohortry.llm.registry import documents, query
from cohortry.session import staged

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 7, 36
#: Classes per block of a cluster, and shingles per matrix.
BLOCK, COLUMNS = 256, 4096
#: Word hashes that a worker remembers, and shingles that are hashed at once.
REMEMBERED, AT_ONCE = 1 << 18, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = ["class_id", "n_links", "n_copies", "class_key"]


def _odd_numbers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32))


class Shingles:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known, hashed = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            hashed.append(h)
        ids = np.array(hashed, np.uint64)
        n = len(ids) - SHINGLE + 1
        if n < 1:  # a short text is one shingle of all its words
            n, width = min(1, len(ids)), len(ids)
        else:
            width = SHINGLE
        mixed = np.zeros(n, np.uint64)
        for k in range(width):
            mixed = (mixed ^ ids[k:k + n]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def set_key(shingles: np.ndarray) -> int:
    """A 63-bit hash of a whole set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1


def band_hashes(shingles: np.ndarray, numbers) -> np.ndarray:
    """One 64-bit hash per band, over its number and ``ROWS`` MinHash values."""
    factors, masks = numbers
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(folded), AT_ONCE):
        part = (folded[at:at + AT_ONCE, None] ^ masks) * factors
        part ^= part >> np.uint32(15)
        np.minimum(least, part.min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without its text, with ``_set``, the class of the text (null without words), and ``_bands``."""
    def start():
        shingles, numbers = Shingles(), _odd_numbers()

        def compute(batch):
            sets, bands = [], []
            for t in texts_of(batch, text):
                found = shingles(t)
                sets.append(set_key(found) if len(found) else None)
                bands.append(band_hashes(found, numbers) if len(found) else None)
            return [sets, bands]
        return compute

    return add_columns(docs, [T.StructField("_set", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))], start, [text],
                       keep_inputs=False)


def linked(sets: list[np.ndarray], split: int, threshold: float) -> list[tuple[int, int, int]]:
    """(place, number of links, smallest place it is connected with) for each set that has a link.

    Sets from ``split`` on are another block and are compared with the earlier ones only;
    with ``split`` 0 all are compared with each other.
    """
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    values = np.concatenate(sets)
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    # A shingle of one set alone is in no intersection.
    new = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    shared = times[column] > 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (slice(0, split), slice(split, k)) if split else (slice(0, k), slice(0, k))
    common = np.zeros((left.stop - left.start, right.stop - right.start), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        held = np.zeros((k, COLUMNS), np.float32)
        held[row[a:b], column[a:b] - i * COLUMNS] = 1
        common += held[left] @ held[right].T
    similar = common >= threshold * (sizes[left, None] + sizes[None, right] - common) - 1e-9
    if not split:
        np.fill_diagonal(similar, False)
    links = np.zeros(k, np.int64)
    links[left] += similar.sum(axis=1)
    if split:
        links[right] += similar.sum(axis=0)
    label = np.arange(k)
    a, b = np.nonzero(similar)
    b = b + right.start
    while True:  # smallest label along the links
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(i, int(links[i]), int(label[i])) for i in np.flatnonzero(links)]


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(``a`` class, ``b`` smallest class connected in a group, ``n`` links in it), from (``_set``, cluster, blocks, block, shingles)."""
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = members.select("*", other.alias("_other")).select(
        "_cluster", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "_set", "_shingles")
    grouped = paired.repartition("_cluster", "_low", "_high").sortWithinPartitions("_cluster", "_low", "_high", "_block", "_set")

    def compare(key, rows):
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        split = next((i for i, r in enumerate(rows) if r[0] != key[1]), 0) if key[1] != key[2] else 0
        if key[1] != key[2] and (split == 0 or split == len(rows)):
            return []  # one of the blocks is empty
        return [(rows[i][1], rows[j][1], n) for i, n, j in linked(sets, split, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, out = None, [], []
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("_cluster", "_low", "_high", "_block", "_set", "_shingles")]
            for cluster, low, high, block, s, shingles in zip(*columns, strict=True):
                if (cluster, low, high) != last:
                    out += compare(last, rows)
                    last, rows = (cluster, low, high), []
                if not rows or rows[-1][1] != s:
                    rows.append((block, s, shingles))
            if len(out) > 4096:
                yield _links(out)
                out = []
        out += compare(last, rows)
        yield _links(out)

    return grouped.mapInArrow(run, "a long, b long, n long")


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "n"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``class_id``, ``n_links``, ``n_copies`` and ``class_key``.

    ``class_id`` is the smallest id among the texts that are connected by links, ``n_links``
    the number of different shingle sets that are similar to the row's, and ``n_copies`` the
    rows with the same set. Texts of any length are compared whole. Words are what white space parts, in lower case; a text of
    fewer than five is one shingle. Null and empty texts have no set and are alone, with
    their own id as class. Rows with a null id take part; a class of null ids alone has a null
    ``class_id``. ``class_key`` tells classes apart even so; it is null without words. Repeated rows are copies. An empty table stays empty. Columns of ``docs`` with
    a name of the result are replaced, all other names are free.
    """
    rows, own = pack(docs, doc_id, text, RESULT), unpacked(docs, doc_id, text, RESULT)
    thin = staged(signatures(rows, "_text"), "signatures")
    with_set = thin.filter(F.col("_set").isNotNull())
    classes = with_set.groupBy("_set").agg(F.min("_id").alias("_first"), F.count("*").alias("n_copies"))

    # Candidates: copies fold into one row per band before they shuffle.
    bands = with_set.select("_set", F.explode("_bands").alias("_band"))
    buckets = bands.groupBy("_band").agg(F.min("_set").alias("_centre"), F.max("_set").alias("_top"))
    buckets = buckets.filter("_centre <> _top").drop("_top")
    star = bands.distinct().join(buckets, "_band").select(F.col("_set").alias("a"), F.col("_centre").alias("b"))
    clusters = components(star)

    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    members = clusters.join(sizes, "label").join(classes.select("_set", "_first"), F.col("node") == F.col("_set")).select(
        F.col("label").alias("_cluster"), "_blocks", "_set", F.pmod(F.xxhash64("_set"), "_blocks").cast("int").alias("_block"), "_first")
    fetched = rows.select("_id", "_text").join(members, F.col("_id").eqNullSafe(F.col("_first")))

    def start():
        shingles = Shingles()

        def compute(batch):
            found = [shingles(t) for t in texts_of(batch, "_text")]
            return [[set_key(f) if len(f) else None for f in found], [f.tobytes() for f in found]]
        return compute

    # Of several rows with the id of a class, those with its set stay; equal ones are taken once.
    sets = add_columns(fetched, [T.StructField("_own", T.LongType()), T.StructField("_shingles", T.BinaryType())], start, ["_text"],
                       keep_inputs=False)
    sets = sets.filter("_own = _set").select("_set", "_cluster", "_blocks", "_block", "_shingles")
    found = staged(verified(sets, threshold), "verified")

    joined = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("_set")).agg(F.sum("n").alias("n_links"))
    told = classes.join(joined.withColumnRenamed("node", "_set"), "_set", "left").join(links, "_set", "left")
    told = told.withColumn("_label", F.coalesce("label", "_set"))
    named = told.groupBy("_label").agg(F.min("_first").alias("class_id"))
    told = staged(told.join(named, "_label").select("_set", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies",
                                                    F.col("_label").alias("class_key")), "classes")

    alone = thin.filter(F.col("_set").isNull()).select(
        *own, F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"),
        F.lit(None).cast("long").alias("class_key"))
    return with_set.drop("_bands").join(told, "_set").select(*own, *RESULT).unionByName(alone)


@query("op2_jaccard_join")
def _(spark, d):
    return near_duplicates(documents(spark, d).select("doc_id", "text"))
