"""Removal of byte strings that occur earlier, in the same or another text, by suffix sorting.

Sorting every suffix of a corpus would move each byte of it many times. But a string of
``LENGTH`` bytes can only occur twice where the smallest hash among its substrings of ``GRAM``
bytes, its anchor, does. So

1. anchors of all strings are found by a sliding minimum; of each run of strings with the same
   anchor one row is made. Anchors whose hash occurs once are dropped by a join.
2. The strings of one anchor lie in one span of text. Of equal spans (equal hash of the anchor
   and equal digest of the bytes) the earliest stays a candidate; the others are repeats.
3. Candidates that share an anchor hash are dealt by it. The many spans of a hot hash are first cut into
   parts of ``PART`` starts and dealt by the bytes that all strings of a part have: equal strings
   still meet, and parts that are alone drop out. Only parts of more than ``CHUNK`` spans lie in chunks.
   Each task sorts the suffixes at all starts of strings in its spans, see
   :mod:`cohortry.llm.suffix_sort`; in each run of suffixes that agree in ``LENGTH`` bytes all
   but the earliest are repeats.
4. The strings that are left of parts in chunks, at most one per chunk for each text, are merged
   over chunks by an aggregate on their bytes.

The repeats become spans of their documents, which are cut out in a last pass. Copies combine
within tasks before they move, and no group is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.llm.arrow_rows import add_columns, slices, texts_of
from cohortry.llm.registry import documents, query
from cohortry.llm.skew import split_join
from cohortry.llm.suffix_sort import Prefixes, sort_suffixes
from cohortry.session import staged

LENGTH = 100
#: Bytes of the substrings whose hashes are compared for an anchor.
GRAM = 24
#: Windows of a text that are hashed at once; with the bytes after them they have 16-bit places.
BLOCK = 1 << 15
#: Bits of a hash that are kept, and those of the two ends of an anchor's starts in ``_at``.
HASH_BITS, END_BITS = 48, 10
#: Spans of one anchor hash that a task sorts together, and suffixes sorted at once, about.
CHUNK, TOGETHER = 4096, 1 << 18
#: Starts of strings, as told from their anchor, in one part of a span of a hot hash.
PART = 8
#: Largest ``length`` that fits the bits above.
LONGEST = 1 << END_BITS

PLACE = ["_none", "_doc", "_tag", "_at"]
REMOVED = [T.StructField("removed", T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())]


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes: hash, place, and the first and last start of their strings.

    An anchor is the last place with the smallest hash, so it depends on nothing but the string.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    text = np.frombuffer(raw, np.uint8)
    width = length - gram + 1
    places = np.empty(n, np.int64)
    hashes = np.empty(n, np.int64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        grams = Prefixes(text[at:at + size + length - 1]).grams(gram)
        low = (grams >> np.uint64(64 - HASH_BITS) << np.uint64(16)) | np.arange(0xFFFF, 0xFFFF - len(grams), -1).astype(np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        places[at:at + size] = at + 0xFFFF - (low & np.uint64(0xFFFF)).astype(np.int64)
        hashes[at:at + size] = (low >> np.uint64(16)).astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], n) - 1
    return hashes[first], places[first], first, last


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place, and how far before it the last and the first string start, in one number."""
    return (place << 2 * END_BITS) | (place - last << END_BITS) | (place - first)


def _starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last start of the strings of packed anchors."""
    place, mask = at >> 2 * END_BITS, LONGEST - 1
    return place - (at & mask), place - (at >> END_BITS & mask)


def _anchor_rows(docs: DataFrame, length: int, gram: int, full: bool) -> DataFrame:
    """A row per anchor: ``_gram``, and if ``full`` also where it is and a digest of its span."""
    kinds = [T.StructField("_gram", T.LongType())]
    if full:
        kinds += [docs.schema["_doc"], docs.schema["_tag"], T.StructField("_at", T.LongType()), T.StructField("_span", T.LongType())]
    schema = T.StructType(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            found, counts = [], []
            for raw in batch.column("_text").to_pylist():
                hashes, place, first, last = anchors(raw, length, gram)
                counts.append(len(hashes))
                if not len(hashes):
                    continue
                if full:
                    at = _packed(place, first, last)
                    seeds = at & ((1 << 2 * END_BITS) - 1)
                    spans = np.array([digest(raw[a:b + length], s) for a, b, s in
                                      zip(first.tolist(), last.tolist(), seeds.tolist(), strict=True)], np.uint64).view(np.int64)
                    found.append((hashes, at, spans))
                else:
                    found.append((hashes,))
            if not found:
                continue
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)]
            if full:
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                columns[1:1] = [batch.column("_doc").take(row), batch.column("_tag").take(row)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return (docs if full else docs.select("_text")).mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Whole groups of equal (``_gram``, ``_chunk``) from sorted rows, about ``most`` rows together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        gram, chunk = table.column("_gram").to_numpy(), table.column("_chunk").to_numpy()
        changes = np.flatnonzero((np.diff(gram) != 0) | (np.diff(chunk) != 0))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
        else:
            held, n = table.to_batches(), table.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _sorted_spans(spans: DataFrame, length: int) -> DataFrame:
    """Repeats within each (``_gram``, ``_chunk``) and, of groups in chunks, the strings that are left.

    Rows are the document with ``start`` and ``end`` of repeated bytes, or with ``start`` and
    ``_string`` for a string that is left.
    """
    schema = T.StructType([*[spans.schema[c] for c in PLACE[:3]], T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("_string", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for table in _groups(batches, max(1, TOGETHER // length)):
            n = table.num_rows
            rank = np.empty(n, np.int64)
            rank[pc.sort_indices(table.select(PLACE), sort_keys=[(c, "ascending") for c in PLACE], null_placement="at_end").to_numpy()] = np.arange(n)
            first, last = _starts(table.column("_at").to_numpy())
            place = table.column("_at").to_numpy() >> 2 * END_BITS
            pieces = table.column("_bytes").to_pylist()
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            base = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
            counts = last - first + 1
            span = np.repeat(np.arange(n), counts)
            step = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = first[span] + step
            # Equal strings have the same anchor, as far from their start.
            gram, chunk = table.column("_gram").to_numpy(), table.column("_chunk").to_numpy()
            group = np.cumsum(np.append(0, (np.diff(gram) != 0) | (np.diff(chunk) != 0)))
            key = group[span] * LONGEST + (place[span] - start)
            dealt = np.argsort(key, kind="stable")
            changes = np.diff(key[dealt], prepend=-1, append=-1) != 0
            dealt = dealt[~(changes[:-1] & changes[1:])]  # a string alone with its key is no repeat
            # Places in one span differ in their key, so the span's rank orders the strings of a segment.
            order, same = sort_suffixes(raw, (base[span] + step)[dealt], key[dealt], rank[span][dealt], length)
            repeated = np.zeros(len(span), bool)
            repeated[dealt[order[same]]] = True
            # Repeated starts that follow each other in one span are one piece of text.
            here = np.flatnonzero(repeated)
            opens = np.flatnonzero((np.diff(here, prepend=-2) != 1) | (np.diff(span[here], prepend=-1) != 0))
            closes = np.append(opens[1:], len(here)) - 1 if len(opens) else opens
            rows, begin, end = span[here[opens]], start[here[opens]], start[here[closes]] + length
            left = np.flatnonzero(~repeated & table.column("_chunked").to_numpy()[span])
            strings = [pieces[s][k:k + length] for s, k in zip(span[left].tolist(), step[left].tolist(), strict=True)]
            rows = np.concatenate([rows, span[left]])
            columns = [table.column(c).combine_chunks().take(pa.array(rows)) for c in PLACE[:3]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate([begin, start[left]]), pa.int64()),
                 pa.array([*end.tolist(), *[None] * len(left)], pa.int64()),
                 pa.array([*[None] * len(begin), *strings], pa.binary())], schema=arrow)

    return spans.mapInArrow(run, schema)


def _parts(raw: bytes, at: int, length: int, gram: int) -> list[tuple[int, int, bytes]]:
    """The parts of the span of a packed anchor: each packed, with the hash of what all its strings have, and its bytes.

    Strings whose anchor is between ``a`` and ``a + PART - 1`` bytes after their start, and equal ones
    are as far from it, have the ``a`` bytes before the anchor and those after it up to the end of the first.
    """
    place, mask = at >> 2 * END_BITS, LONGEST - 1
    least, most = at >> END_BITS & mask, at & mask
    out = []
    for a in range(least // PART * PART, most + 1, PART):
        b = min(a + PART - 1, length - gram)
        low, high = max(a, least), min(b, most)
        key = xxhash.xxh3_64_intdigest(raw[place - a:place - b + length], a) - (1 << 63)
        out.append(((place << 2 * END_BITS) | (low << END_BITS) | high, key, raw[place - high:place - low + length]))
    return out


def _with_bytes(candidates: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``candidates`` with the bytes of their spans; those that are ``_often`` in parts, with the hash ``_key`` of each."""
    keys = ["_none", "_doc", "_tag"]
    passed = ["_gram", "_often", "_at"]
    lists = candidates.groupBy(*keys).agg(F.collect_list(F.struct(*passed)).alias("_list"))
    named = lists.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    read = docs.join(named, same).select(*keys, "_list", "_text")
    schema = T.StructType([*[read.schema[c] for c in keys], *[candidates.schema[c] for c in passed],
                           T.StructField("_key", T.LongType()), T.StructField("_bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in slices(batches):
            list_column = batch.column("_list")
            counts = pc.list_value_length(list_column).to_numpy()
            flat = list_column.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(batch.num_rows), counts)
            at, hot = flat.field("_at").to_numpy(), flat.field("_often").to_numpy(zero_copy_only=False)
            texts = batch.column("_text").to_pylist()
            cold = np.flatnonzero(~hot)
            first, last = _starts(at[cold])
            pieces = [texts[r][a:b + length] for r, a, b in zip(row[cold].tolist(), first.tolist(), last.tolist(), strict=True)]
            of, at_of, part = cold.tolist(), at[cold].tolist(), [0] * len(cold)
            for k in np.flatnonzero(hot).tolist():
                for packed, key, piece in _parts(texts[row[k]], int(at[k]), length, gram):
                    of.append(k)
                    at_of.append(packed)
                    part.append(key)
                    pieces.append(piece)
            taken = pa.array(row[of])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(taken) for c in keys], *[flat.field(c).take(pa.array(of, pa.int64())) for c in passed[:2]],
                 pa.array(at_of, pa.int64()), pa.array(part, pa.int64()), pa.array(pieces, pa.binary())], schema=arrow)

    return read.mapInArrow(run, schema)


def _tagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_none`` and ``_tag``, which tells texts apart that share an id, and ``_shared``, whether one does."""
    shared = staged(rows.groupBy(F.col("_doc").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "ids")
    if shared.isEmpty():  # then no text needs to be looked at
        rows = rows.withColumns({"_tag": F.lit(0).cast("long"), "_shared": F.lit(False)})
    else:
        own = F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))
        rows = split_join(rows, shared.withColumnRenamed("_id", "_doc"), "_doc", "_rows", "left").withColumn(
            "_shared", F.col("_rows").isNotNull()).withColumn("_tag", F.when(F.col("_shared"), own).otherwise(F.lit(0).cast("long"))).drop("_rows")
    return rows.withColumn("_none", F.col("_doc").isNull())


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What tells the removed bytes of each text: the key columns, ``_at`` and ``end``.

    A row without ``end`` is an anchor of repeated hash, packed in ``_at``; one with -1 says that this
    anchor's span is the first of its kind, so it is no repeat as a whole. Other rows are pieces
    of repeated bytes from ``_at`` to ``end``. ``docs`` has the key columns and the bytes ``_text``.
    """
    seen = staged(_anchor_rows(docs, length, gram, False).groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "grams")
    rows = staged(split_join(_anchor_rows(docs, length, gram, True), seen, "_gram", "_rows").drop("_rows")
                  .withColumn("_none", F.col("_doc").isNull()), "anchors")
    firsts = staged(rows.groupBy("_gram", "_span").agg(F.min(F.struct(*PLACE)).alias("_first")).select("_gram", "_first.*"), "firsts")

    shared = staged(firsts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_spans")).filter("_spans > 1"), "shared")
    candidates = split_join(firsts, shared, "_gram", "_spans").select(*PLACE, "_gram", (F.col("_spans") > CHUNK).alias("_often"))
    pieces = staged(_with_bytes(candidates, docs, length, gram), "spans")
    hot, given = pieces.filter("_often"), [*PLACE, "_gram", "_bytes"]
    sizes = staged(hot.groupBy("_key").agg(F.count(F.lit(1)).alias("_spans")).filter("_spans > 1"), "parts")
    chunks = F.ceil(F.col("_spans") / CHUNK)
    # The part and the chunk in one number: two of one anchor hash that agree in it would just be sorted together.
    parts = split_join(hot, sizes, "_key", "_spans").select(
        *given, F.xxhash64("_key", F.pmod(F.xxhash64(*PLACE), chunks)).alias("_chunk"), (chunks > 1).alias("_chunked"))
    spans = pieces.filter("NOT _often").select(*given, F.lit(0).cast("long").alias("_chunk"), F.lit(False).alias("_chunked")).unionByName(
        parts).repartition("_gram", "_chunk").sortWithinPartitions("_gram", "_chunk")
    found = staged(_sorted_spans(spans, length), "sorted")

    left = found.filter("_string IS NOT NULL").drop("end")
    first_of = left.groupBy("_string").agg(F.min(F.struct("_none", "_doc", "_tag", "start")).alias("_first")).select("_first.*")
    keys = ["_none", "_doc", "_tag", "start"]
    again = left.join(first_of.withColumnsRenamed({k: f"{k}_of" for k in keys}),
                      [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys], "left_anti")
    key = PLACE[:3]
    pieces = found.filter("_string IS NULL").select(*key, "start", "end").unionByName(again.select(*keys, (F.col("start") + length).alias("end")))
    none = F.lit(None).cast("long")
    return rows.select(*key, "_at", none.alias("end")).unionByName(
        firsts.select(*key, "_at", F.lit(-1).cast("long").alias("end"))).unionByName(pieces.withColumnRenamed("start", "_at"))


def _spans(events: list[dict], length: int) -> list[tuple[int, int]]:
    """The removed spans of one text from the rows that :func:`repeats` has for it."""
    firsts = {e["_at"] for e in events if e["end"] == -1}
    copies = np.array([e["_at"] for e in events if e["end"] is None and e["_at"] not in firsts], np.int64)
    first, last = _starts(copies)
    pieces = [(e["_at"], e["end"]) for e in events if (e["end"] or -1) >= 0]
    return merged(sorted([*zip(first.tolist(), (last + length).tolist(), strict=True), *pieces]))


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``removed`` and ``kept``; columns of these names are replaced.

    Texts are UTF-8 bytes. ``removed`` has start and end of each stretch of bytes that strings of
    ``length`` bytes cover which also start earlier, in a text with a smaller id or further in
    front in the same text; ``kept`` has the other bytes. Strings are judged on the input, matches never
    cross texts.

    Null and empty texts, and those of fewer than ``length`` bytes, lose nothing. Null ids come after
    all others. Texts that share an id are ordered by their CRC-32, and rows that share id and
    CRC-32 count as one text, so each of them keeps the same. An empty table stays empty. A task holds
    single texts whole; texts are hashed in blocks of ``BLOCK`` bytes.
    """
    if not gram < length < LONGEST:
        raise ValueError(f"gram < length < {LONGEST} is needed")
    own, key = ("removed", "kept"), PLACE[:3]
    others = [c for c in docs.columns if c not in own]
    rows = _tagged(docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in others if c != text]).alias("_row"),
                               F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text")))
    raw = rows.select(*key, "_shared", F.coalesce("_text", F.lit("")).cast("binary").alias("_text"))
    if rows.filter("_shared").isEmpty():
        raw = raw.drop("_shared")
    else:  # rows with the same key are one text
        raw = raw.filter("NOT _shared").drop("_shared").unionByName(
            raw.filter("_shared").groupBy(*key).agg(F.first("_text").alias("_text")))
    pieces = repeats(raw, length, gram).groupBy(*key).agg(
        F.collect_list(F.struct("_at", "end")).alias("_pieces")).withColumnsRenamed({k: f"{k}_of" for k in key})
    joined = rows.join(pieces, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in key], "left")

    def compute(batch: pa.RecordBatch) -> list:
        removed, kept = [], []
        for raw, found in zip(texts_of(batch, "_text"), batch.column("_pieces").to_pylist(), strict=True):
            raw = raw.encode()
            spans = _spans(found, length) if found else []
            removed.append([{"start": a, "end": b} for a, b in spans])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept.append(b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if spans else raw)
        return [removed, kept]

    made = add_columns(joined.select("_row", "_text", "_pieces"), REMOVED, lambda: compute, ["_text", "_pieces"])
    return made.select(*[F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in others], *own)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@query("op12_suffix_dedup")
def _(spark, d):
    rows = suffix_dedup(documents(spark, d).select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), gone.alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
