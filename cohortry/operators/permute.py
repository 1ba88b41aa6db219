"""Label permutation without replacement, and the null it gives.

Rows are numbered once. In replicate r the row with number i gets the label at place
π_r(i), for a keyed permutation π_r (see :mod:`cohortry.functions.keyed`), of the labels laid out
one after another; their running counts tell which one that is. So a replicate costs
arithmetic per row, and neither rows nor labels are sorted or exchanged for it.

A network reaches few of the orders of a handful of rows evenly. Where ``ranked`` is asked, each replicate
orders the rows anew by a digest of their name, so that every order is as likely; that costs a digest and a
place in a sort per row and replicate, which move.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.functions import keyed
from cohortry.functions.digest import digests
from cohortry.operators.contingency import chisq_by
from cohortry.operators.joins import heavy_keys, natural_join
from cohortry.session import staged

# Executors get these functions with the job and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HEX = 8  # leading hash digits that cut the order into ranges
#: Rows that are numbered in one window, about.
ROWS_PER_SLOT = 20_000
#: Replicates whose presence shares one number.
BITS = 62
#: Rows whose replicates a task holds at once.
ROWS_AT_ONCE = 2000
#: Bytes of the pairs of a row and a replicate that are ranked together, about.
BYTES_PER_SLOT = 1 << 25


def hashed(df: DataFrame, row_id: str, seed: int) -> tuple[DataFrame, int]:
    """``df`` with the hash of ``row_id`` in its place, staged so that the rows are made once, and their number."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(0), F.col(row_id).cast("string")))
    rows = staged(df.withColumn("_hash", digest).drop(row_id), "hashed")
    return rows, rows.count()


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of :func:`hashed` with ``_number`` from 0 on in the order of their hash.

    A hash is spread evenly, so its leading digits cut the rows into ranges of equal size;
    only the counts per range are summed over the whole.
    """
    wide = max(16, -(-n // ROWS_PER_SLOT))
    lead = F.conv(F.substring("_hash", 1, _HEX), 16, 10).cast("long")
    cut = rows.withColumn("_slot", F.shiftright(lead * wide, 4 * _HEX).cast("int"))
    slots = cut.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per ROWS_PER_SLOT
    slots = slots.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy("_hash")
    return cut.withColumn("_row", F.row_number().over(inside)).join(slots, "_slot").withColumn(
        "_number", F.col("_before") + F.col("_row") - 1).drop("_hash", "_slot", "_row", "_before")


def _parts(df: DataFrame) -> int:
    """Parts for rows each of which costs much: a fixed number is not coalesced again."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _layout(rows: DataFrame, label: str) -> DataFrame:
    """Each label with its code and the places it takes, staged."""
    counts = staged(rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")), "labels")
    order = Window.orderBy(F.col("_label").asc_nulls_last())  # one row per label
    return staged(counts.select("_label", (F.row_number().over(order) - 1).alias("_code"), F.sum("_n").over(order).alias("_upto")), "labels")


def _places(rows: DataFrame, layout: DataFrame, reps: int, seed: int):
    """What a task needs to look labels up, broadcast: the running counts of the labels and the keys of the replicates.

    There is one count per label of a column that is a class, by which cells are counted. They are as
    many as the cells' classes, not the rows.
    """
    upto = [r[0] for r in layout.orderBy("_code").select("_upto").collect()]
    return rows.sparkSession.sparkContext.broadcast((np.array(upto, np.int64), keyed.round_keys(seed, reps)))


def codes_of(number: np.ndarray, n: int, upto: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The label codes of rows by replicate."""
    out = np.empty((len(number), len(keys)), np.int32)
    for r, key in enumerate(keys):
        out[:, r] = np.searchsorted(upto, keyed.permuted(number, n, key), side="right")
    return out


def presence(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each row and code that it has in any replicate: both, and the replicates as bits."""
    rows, reps = codes.shape
    one = (np.arange(rows)[:, None] * (1 << 31) + codes).ravel()
    order = np.argsort(one, kind="stable")
    first = np.flatnonzero(np.diff(one[order], prepend=-1))
    rep = order % reps
    bits = [np.bitwise_or.reduceat(np.where(rep // BITS == w, np.int64(1) << (rep % BITS), 0), first) for w in range(words)]
    found = one[order][first]
    return found >> 31, found & ((1 << 31) - 1), bits


def permute_label(df: DataFrame, row_id: str, label: str, reps: int, seed: int = 123,
                  carry: list[str] = (), ranked: bool = False) -> DataFrame:
    """``reps`` shuffles of ``label`` over the rows; ``row_id`` must be unique.

    Returns ``rep``, the carried columns and the shuffled label. Every rep keeps
    the label's counts, and the same seed gives the same shuffle on any cluster.
    With ``ranked`` each rep ranks the rows by ``md5(seed|rep|row_id)``, and a row gets the label of
    the row that has its rank in rep 0; without it the order of a rep is a keyed permutation.
    """
    carry = list(carry)
    if ranked:
        return _ranked_labels(df, row_id, label, reps, seed, carry)
    base, n = hashed(df.select(F.col(row_id).alias("_id"), label, *[F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]), "_id", seed)
    layout = _layout(base, label)
    shared = _places(base, layout, reps, seed)
    # Each row becomes many: spread them first.
    rows = staged(numbered(base.drop(label), n).repartition(_parts(base), "_number"), "numbered")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(number: pd.Series) -> pd.Series:
        return pd.Series(list(codes_of(number.to_numpy(np.int64), n, *shared.value)))

    coded = rows.select(*[F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)], codes("_number").alias("_codes"))
    long = coded.select(*carry, F.posexplode("_codes").alias("_rep", "_code"))
    named = long.join(layout.select("_code", F.col("_label").alias(label)), "_code")
    return named.select((F.col("_rep") + 1).alias("rep"), *carry, label)


def named_digests(names: pa.Array, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of ``md5(seed|rep|name)``, one row for each of replicates 1 to ``reps``. As concat_ws does, a missing name is left out."""
    return digests([f"{seed}|{rep + 1}".encode() for rep in range(reps)],
                   [b"" if name is None else b"|" + name for name in names.to_pylist()])


def _slots(first: np.ndarray, wide: int) -> np.ndarray:
    """Which of ``wide`` equal ranges of digests the first halves are in."""
    return ((first >> np.uint64(32)) * np.uint64(wide) >> np.uint64(32)).astype(np.int64)


def in_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The places of digests in their order; the second halves are looked at only where first halves are equal."""
    order = np.argsort(first)
    lined = first[order]
    return np.lexsort((second, first)) if (lined[1:] == lined[:-1]).any() else order


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _ranked_labels(df: DataFrame, row_id: str, label: str, reps: int, seed: int, carry: list[str]) -> DataFrame:
    """Labels by the rank of a row's digest in each replicate.

    Digests are spread evenly, so the range of all digests is cut into slots of about as many pairs of row and
    replicate. The pairs are counted first, by which each slot knows the places its pairs will have, and the labels of those places
    go to it: the slots of replicates begin at nearly the same place, so that a label goes to one or two slots. Then a pair moves
    once, to its slot, where its rank is told.
    """
    carried = [f"_carry{k}" for k in range(len(carry))]
    named = df.select(F.col(row_id).cast("string").alias("_id"), F.col(label).alias("_label"), *[F.col(c).alias(a) for c, a in zip(carry, carried)])
    base = staged(named, "named")
    n, size = base.agg(F.count(F.lit(1)), sum((F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for c in ["_label", *carried]), F.lit(0))).first()
    schema = T.StructType([T.StructField("_rep", T.IntegerType()), *[T.StructField(a, base.schema[a].dataType) for a in carried],
                           T.StructField("_label", base.schema["_label"].dataType)])
    if not n or reps < 1:
        return _outer(df.sparkSession.createDataFrame([], schema), carry, carried, label)
    per_slot = max(1, BYTES_PER_SLOT // (32 + size // n))
    wide = -(-n * reps // per_slot)
    at_once = max(1, 2 * per_slot // reps)
    rows = base.withColumn("_id", F.col("_id").cast("binary")).drop("_label")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs per slot and replicate."""
        for batch in _together(batches, at_once):
            slot = _slots(named_digests(batch.column("_id"), reps, seed)[0], wide)
            cell, count = np.unique(slot * reps + np.arange(reps)[:, None], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell // reps), pa.array((cell % reps + 1).astype(np.int32)), pa.array(count)], names=["_slot", "_rep", "_n"])

    counts = rows.select("_id").repartition(_parts(base), "_id").mapInArrow(sizes, "_slot long, _rep int, _n long")
    before = Window.partitionBy("_rep").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per slot
    begins = staged(counts.groupBy("_slot", "_rep").agg(F.sum("_n").alias("_n")).withColumn(
        "_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))), "slots")
    ends = begins.groupBy("_slot").agg(F.min("_begin").alias("_low"), F.max(F.col("_begin") + F.col("_n")).alias("_high")).orderBy("_slot").collect()
    slot, low, high = (np.array(column, np.int64) for column in zip(*ends))
    # A slot without a pair of some replicate may begin too late or end too early for its neighbours; more labels do no harm.
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    shared = base.sparkSession.sparkContext.broadcast((slot, low, high))

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each label for the slots that may have its place."""
        slot, low, high = shared.value
        for batch in batches:
            place = batch.column("_number").to_numpy()
            first = np.searchsorted(high, place, side="right")
            copies = np.searchsorted(low, place, side="right") - first
            row = np.repeat(np.arange(len(place)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(slot[first[row] + nth]), pa.array(place[row]), batch.column("_label").take(pa.array(row))],
                                             names=["_slot", "_begin", "_label"])

    places = numbered(base.select("_label", F.md5(F.concat_ws("|", F.lit(seed), F.lit(0), "_id")).alias("_hash")), n)
    label_type = T.StructType([T.StructField("_slot", T.LongType()), T.StructField("_begin", T.LongType()), schema["_label"]])
    labels = places.select("_label", F.col("_number").cast("long").alias("_number")).mapInArrow(to_slots, label_type)
    # A slot gets the places of its labels and, in the same column, where its replicates begin.
    beside = labels.withColumn("_rep", F.lit(None).cast("int")).unionByName(begins.select("_slot", "_rep", "_begin"), allowMissingColumns=True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a slot packed, so that few rows move."""
        for batch in _together(batches, at_once):
            halves = named_digests(batch.column("_id"), reps, seed)
            of = _slots(halves[0], wide).ravel()
            order = np.argsort(of.astype(np.int16) if wide < 1 << 15 else of, kind="stable")
            rep, row = np.divmod(order, batch.num_rows)
            columns = [pa.array((rep + 1).astype(np.int32)), *[pa.array(half.ravel()[order]) for half in halves],
                       *[batch.column(a).take(pa.array(row)) for a in carried]]
            lined = pa.RecordBatch.from_arrays(columns, names=["_rep", "_first", "_second", *carried])
            cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=wide))
            packed = [_packed(lined.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(of[order][cuts[:-1]]), pa.array(packed, pa.binary())], names=["_slot", "_pairs"])

    def labelled(left: pa.Table, right: pa.Table) -> pa.Table:
        """The labels of a slot's pairs."""
        mine = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for c in left.column("_pairs").chunks for p in c]).combine_chunks()
        rep, first, second = (mine.column(c).to_numpy() for c in ("_rep", "_first", "_second"))
        by_rep = np.argsort(rep.astype(np.int16) if reps < 1 << 15 else rep, kind="stable")
        is_label = right.column("_rep").is_null()
        starts, labels = right.filter(pc.invert(is_label)), right.filter(is_label).sort_by("_begin")
        begin = dict(zip(starts.column("_rep").to_pylist(), starts.column("_begin").to_pylist()))
        lowest = labels.column("_begin")[0].as_py()
        cuts = np.flatnonzero(np.diff(rep[by_rep], prepend=0, append=reps + 1))
        at = np.empty(len(rep), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            some = by_rep[a:b]
            at[some[in_order(first[some], second[some])]] = np.arange(b - a) + (begin[int(rep[some[0]])] - lowest)
        columns = [mine.column("_rep"), *[mine.column(a) for a in carried], labels.column("_label").combine_chunks().take(pa.array(at))]
        # Times come in the session's zone and are asked for in UTC.
        return pa.table([c if c.type == kind else c.cast(kind) for c, kind in zip(columns, kinds)], names=schema.names)

    kinds = to_arrow_schema(schema).types
    many = max(_parts(base), wide // 2)
    moved = rows.repartition(max(_parts(base), wide // 8), "_id").mapInArrow(pairs, "_slot long, _pairs binary").repartition(many, "_slot")
    out = moved.groupBy("_slot").cogroup(beside.repartition(many, "_slot").groupBy("_slot")).applyInArrow(labelled, schema)
    return _outer(out, carry, carried, label)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _outer(out: DataFrame, carry: list[str], carried: list[str], label: str) -> DataFrame:
    """The shuffles under the caller's names."""
    return out.select(F.col("_rep").alias("rep"), *[F.col(a).alias(c) for c, a in zip(carry, carried)], F.col("_label").alias(label))


def distinct_cells(pair: np.ndarray, group: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs per (group, code): the groups, the codes and the counts. ``group`` is that of each pair."""
    seen = np.unique(pair * n_codes + codes)
    cell, count = np.unique(group[seen // n_codes] * n_codes + seen % n_codes, return_counts=True)
    return cell // n_codes, cell % n_codes, count


def _changes(columns: list[pa.Array], rows: int) -> np.ndarray:
    """For each row, whether it is the first or differs from the row before; missing values are equal."""
    out = np.zeros(rows, bool)
    out[:1] = True
    for column in columns:
        place = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= place[1:] != place[:-1]
    return out


def permutation_null(df: DataFrame, row_id: str, label: str, key: list[str], unit: str,
                     reps: int = 100, seed: int = 123) -> DataFrame:
    """Median over the shuffles of distinct ``unit`` per (key, label) cell.

    A shuffle in which a cell is absent does not enter its median. Rows of one key and unit are
    brought together before they are shuffled, so that a task counts its units itself: what moves is
    each row once and then a count per cell and replicate. A key and unit that would be more than a
    task's share is dealt over the tasks, and the replicates in which it has a label move as bits.
    """
    key = list(key)
    keys = [f"_k{i}" for i in range(len(key))]
    base, n = hashed(df.select(F.col(row_id).alias("_id"), F.col(label).alias("_label"), *[F.col(k).alias(a) for k, a in zip(key, keys)],
                               F.col(unit).alias("_unit")), "_id", seed)
    layout = _layout(base, "_label")
    shared = _places(base, layout, reps, seed)
    parts = _parts(base)
    # A missing unit is no unit, as in any distinct count.
    heavy = heavy_keys(base.filter(F.col("_unit").isNotNull()), [*keys, "_unit"], parts)
    known = numbered(base.drop("_label"), n).filter(F.col("_unit").isNotNull()).withColumn("_number", F.col("_number").cast("long"))
    counts = ["_rep", *keys, "_code", "_n"]
    if heavy.isEmpty():
        found = _light_counts(known, keys, n, parts, shared).select(*counts)
    else:  # fewer keys than ``parts``
        hashes = F.broadcast(heavy.select(F.col("_heavy").alias("_hash")))
        known = known.withColumn("_hash", F.xxhash64(*keys, "_unit"))
        found = _light_counts(known.join(hashes, "_hash", "left_anti"), keys, n, parts, shared).select(*counts).unionByName(
            _heavy_counts(known.join(hashes, "_hash", "left_semi"), keys, n, parts, reps, shared).select(*counts))
    cells = found.groupBy("_rep", *keys, "_code").agg(F.sum("_n").alias("n_unit"))
    # At most ``reps`` values per cell, so the built-in median is bounded.
    medians = cells.groupBy(*keys, "_code").agg(F.median("n_unit").alias("null_median"))
    return medians.join(layout, "_code").select(*[F.col(a).alias(k) for k, a in zip(key, keys)], F.col("_label").alias(label), "null_median")


def _light_counts(known: DataFrame, keys: list[str], n: int, parts: int, shared) -> DataFrame:
    """Units per replicate, key and code; a unit of a key counts in one task."""
    near = known.select(*keys, "_unit", "_number").repartition(parts, *keys, "_unit").sortWithinPartitions(*keys, "_unit")
    schema = T.StructType([*[near.schema[k] for k in keys], T.StructField("_code", T.LongType()),
                           T.StructField("_rep", T.IntegerType()), T.StructField("_n", T.LongType())])
    here = len(keys)

    def counted(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        upto, rounds = shared.value
        first = _changes(batch.columns[:here], batch.num_rows)
        pair, group = np.cumsum(starts) - 1, (np.cumsum(first) - 1)[starts]
        number, found = batch.column("_number").to_numpy(), []
        for rep, one in enumerate(rounds):
            codes = np.searchsorted(upto, keyed.permuted(number, n, one), side="right")
            of, code, count = distinct_cells(pair, group, codes, len(upto))
            found.append((of, code, np.full(len(of), rep, np.int32), count))
        of, code, rep, count = (np.concatenate(column) for column in zip(*found))
        rows = pa.array(np.flatnonzero(first)[of])
        return pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:here]], pa.array(code), pa.array(rep), pa.array(count)],
                                          names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last unit may go on in the next batch
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            starts = _changes(batch.columns[:here + 1], batch.num_rows)
            last = int(np.flatnonzero(starts)[-1]) if batch.num_rows else 0
            if last and len(shared.value[1]):
                yield counted(batch.slice(0, last), starts[:last])
            held = batch.slice(last)
        if held is not None and held.num_rows and len(shared.value[1]):
            yield counted(held, _changes(held.columns[:here + 1], held.num_rows))

    return near.mapInArrow(run, schema)


def _heavy_counts(known: DataFrame, keys: list[str], n: int, parts: int, reps: int, shared) -> DataFrame:
    """The same for few units of many rows: their rows are dealt by number, and the bits of a unit combine within tasks."""
    words = -(-reps // BITS)
    near = known.select(F.struct(*keys, "_unit").alias("_cell"), "_number").repartition(parts, "_number")
    schema = T.StructType([near.schema["_cell"], T.StructField("_code", T.LongType()),
                           *[T.StructField(f"_w{w}", T.LongType()) for w in range(words)]])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                row, code, bits = presence(codes_of(some.column("_number").to_numpy(), n, *shared.value), words)
                yield pa.RecordBatch.from_arrays([some.column("_cell").take(pa.array(row)), pa.array(code), *map(pa.array, bits)],
                                                 names=schema.names)

    units = near.mapInArrow(seen, schema).groupBy("_cell", "_code").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in range(words)])
    units = units.select("_cell.*", "_code", *[f"_w{w}" for w in range(words)])
    is_set = [F.when(F.getbit(F.col(f"_w{r // BITS}"), F.lit(r % BITS)) == 1, F.lit(r)) for r in range(reps)]
    present = units.select(*keys, "_code", F.explode(F.array_compact(F.array(*is_set))).alias("_rep"))
    return present.groupBy("_rep", *keys, "_code").agg(F.count(F.lit(1)).alias("_n"))


def permutation_test(observed: DataFrame, null: DataFrame, by: list[str], count: str) -> DataFrame:
    """Chi-square test per panel of observed counts against the null medians."""
    both = natural_join(observed, null, "left").withColumn(
        "null_median", F.coalesce("null_median", F.lit(0.0)))
    return chisq_by(both, by, count, "null_median")
