"""Product codes of vectors, with norm-of-sum bounds that save exact scans.

A vector of integers is cut into parts; each part position has a codebook, fitted by rounds
of nearest-entry assignment and averaging. A scan of all entries leaves a lower bound on
the distance to every entry but the nearest, stamped with its round. All codebooks of the
fit are kept. In a later round the bound shrinks by the largest *net* way an entry has gone
since the stamp, the norm of the sum of its moves, which is at most the sum of their norms.
While the exact distance to the own entry stays below that, no other entry can be nearer
and the part is not scanned.

Bounds and codes are the state of a row. They are staged after every round, so a lost
executor costs the tasks of one round. The driver holds codebooks only: parts x entries x
part length numbers a round, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.llm.arrow_rows import slices
from cohortry.llm.registry import query
from cohortry.llm.skew import split_join
from cohortry.session import staged

#: Rows of which distances to all entries are held at once.
SCANNED = 256
#: Vectors with a component beyond this size count as non-finite; squared distances then fit in 64 bits.
LARGEST = float(1 << 20)
#: What rounding can add to or take from a bound, relative and absolute.
SLACK = 1e-9


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts start and end; all are equal where ``parts`` divides ``dim``."""
    return [dim * k // parts for k in range(parts + 1)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry."""
    gap = x[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def net_ways(history: list[np.ndarray]) -> list[np.ndarray]:
    """By round and entry: the largest net way that any other entry has gone since that round."""
    out = []
    for earlier in history:
        gap = (history[-1] - earlier).astype(float)
        ways = np.sqrt((gap * gap).sum(axis=1))
        largest = int(ways.argmax())
        others = np.full(len(ways), ways[largest])
        others[largest] = np.delete(ways, largest).max(initial=0.0)
        out.append(others)
    return out


def assign(x: np.ndarray, history: list[np.ndarray], codes: np.ndarray, low: np.ndarray, stamp: np.ndarray):
    """The nearest entry of the last codebook for each row of one part position.

    Returns codes, lower bounds, their rounds, squared distances, and which rows were scanned.
    Ties go to the lower index: a bound saves a scan only where it shows that the own entry
    is nearer than any other.
    """
    now, entries = len(history) - 1, history[-1]
    codes, low, stamp = codes.copy(), low.copy(), stamp.copy()
    gap = x - entries[codes]
    error = np.einsum("ij,ij->i", gap, gap)
    scan = np.ones(len(x), bool)
    if now:
        ways = np.stack(net_ways(history))
        bound = low - ways[stamp, codes]
        scan = ~(np.sqrt(error.astype(float)) * (1 + SLACK) + SLACK < bound)
    rows = np.flatnonzero(scan)
    for at in range(0, len(rows), SCANNED):
        some = rows[at:at + SCANNED]
        far = squared(x[some], entries)
        best = far.argmin(axis=1)
        line = np.arange(len(some))
        codes[some], error[some] = best, far[line, best]
        if len(entries) > 1:
            far[line, best] = np.iinfo(np.int64).max
            low[some] = np.sqrt(far.min(axis=1).astype(float)) * (1 - SLACK) - SLACK
        else:
            low[some] = np.inf
        stamp[some] = now
    return codes, low, stamp, error, scan


def _round(state: DataFrame, history: list[list[np.ndarray]]) -> DataFrame:
    """The state after one assignment. ``history`` has the codebooks of every part, oldest first."""
    shared = state.sparkSession.sparkContext.broadcast(history)
    schema = state.schema

    def run(batches):
        arrow, books = to_arrow_schema(schema), shared.value
        parts = len(books)
        bounds = np.cumsum([0, *[book[0].shape[1] for book in books]])
        for batch in slices(batches):
            n = batch.num_rows
            if not n:
                continue

            def table(name, dtype, width):
                flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                return flat.astype(dtype).reshape(n, width)

            v = table("_v", np.int64, int(bounds[-1]))
            codes, low, stamp = table("_codes", np.int64, parts), table("_low", float, parts), table("_stamp", np.int64, parts)
            errors, scanned = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
            for k, book in enumerate(books):
                codes[:, k], low[:, k], stamp[:, k], errors[:, k], scan = assign(
                    v[:, bounds[k]:bounds[k + 1]], book, codes[:, k], low[:, k], stamp[:, k])
                scanned += scan
            ends = pa.array(np.arange(n + 1) * parts, pa.int32())

            def lists(name, values):
                kind = arrow.field(name).type.value_type
                return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), kind)).cast(arrow.field(name).type)

            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_v"), lists("_codes", codes), lists("_low", low),
                 lists("_stamp", stamp), lists("_errors", errors), pa.array(scanned, pa.int32())], names=arrow.names)

    return state.mapInArrow(run, schema)


def _averages(state: DataFrame, last: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: floored averages of the parts of each entry; unused entries stay.

    Sums combine within tasks, so one row per part and entry leaves each of them.
    """
    width = [book.shape[1] for book in last]
    starts = np.cumsum([0, *width])
    piece = F.struct(F.col("_part"), F.col("_entry"))
    rows = state.select("_v", F.posexplode("_codes").alias("_part", "_entry"))
    start = F.element_at(F.array(*[F.lit(int(s)) for s in starts[:-1]]), F.col("_part") + 1)
    sums = rows.groupBy(piece.alias("_at")).agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.when(F.element_at(F.array(*[F.lit(w) for w in width]), F.col("_part") + 1) > i,
                     F.get("_v", start + i))).alias(f"_s{i}") for i in range(max(width, default=0))])
    out = [book.copy() for book in last]
    for row in sums.collect():  # one row per part and entry
        part, entry = row["_at"]
        for i in range(width[part]):
            out[part][entry, i] = row[f"_s{i}"] // row["_n"]
    return out


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64,
           rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[list[np.ndarray]]]:
    """Codes of all vectors, and the codebooks of every round (by part, then round).

    A component x becomes floor(scale * x). The codebooks start as the parts of the vectors with
    the ``entries`` smallest ids, fewer if the table has fewer; ``rounds`` times all parts are
    assigned to their nearest entry (ties: the lower index) and entries become floored
    averages; then parts are assigned once more.

    The result has the columns of ``vectors`` and ``codes`` (array of int), ``errors``
    (array of long: the squared distance of each part) and ``scanned`` (parts whose
    entries were all compared in the last assignment); columns of these names are replaced. Rows
    whose vector is null, or has a component that is null, not finite or larger than
    ``LARGEST``, are dropped, and so are those of another length than the kept row with the
    smallest id has. Null ids come last; of equal ids, that with the smaller vector comes
    first. Repeated rows are each encoded. An empty table gives an empty result. Vectors
    of any length are taken; parts differ by one where ``parts`` does not divide it.
    """
    own = ("codes", "errors", "scanned")
    whole = F.col(f"`{vector}`")
    good = whole.isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST))
    packed = vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in vectors.columns if c not in own]).alias("_row"),
        _whole(whole, scale).alias("_v"))
    place = F.struct(F.col(f"_row.`{vec_id}`").isNull().alias("_null"), F.col(f"_row.`{vec_id}`").alias("_id"), F.col("_v"))
    smallest = packed.select(place.alias("_place")).orderBy("_place")
    first = smallest.first()
    dim = len(first["_place"]["_v"]) if first else 0
    packed = packed.filter(F.size("_v") == dim)
    start = [r["_place"]["_v"] for r in smallest.filter(F.size("_place._v") == dim).limit(entries).collect()]
    edges = cuts(dim, parts)
    table = np.array(start, np.int64).reshape(len(start), dim)
    history = [[table[:, edges[k]:edges[k + 1]].copy()] for k in range(parts)]

    def filled(value, kind):
        return F.array_repeat(F.lit(value).cast(kind), parts)

    state = packed.select("_row", "_v", filled(0, "int").alias("_codes"), filled(0, "double").alias("_low"),
                          filled(0, "int").alias("_stamp"), filled(0, "long").alias("_errors"), F.lit(0).alias("_scanned"))
    if start:
        for _ in range(rounds):
            state = staged(_round(state, history), "codes")
            for book, entry in zip(history, _averages(state, [b[-1] for b in history]), strict=True):
                book.append(entry)
        state = staged(_round(state, history), "codes")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in vectors.columns if c not in own]
    return state.select(*kept, F.col("_codes").alias("codes"), F.col("_errors").alias("errors"),
                        F.col("_scanned").alias("scanned")), history


def codebook_digest(history: list[list[np.ndarray]]) -> Column:
    """SHA-256 of the last codebooks' numbers by part, entry and position, joined by commas."""
    numbers = ",".join(str(x) for book in history for x in book[-1].ravel().tolist())
    return F.sha2(F.lit(numbers), 256)


def with_label_error(coded: DataFrame, label: str, error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of equal ``label``, nulls together.

    The sums combine within tasks; a label that holds a large share of the rows is split when
    they are joined back.
    """
    sums = staged(coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(
        F.sum(error).alias(out), F.count(F.lit(1)).alias("_rows")), "labels")
    keyed = coded.withColumn("_label", F.col(f"`{label}`"))
    return split_join(keyed, sums, "_label", "_rows").drop("_label", "_rows")


@query("op11_vector_codes")
def _(spark, d):
    coded, history = encode(spark.read.parquet(f"{d}/embeddings.parquet"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    rows = coded.select("vec_id", "label", F.array_join(digits, "").alias("code"),
                        F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    return with_label_error(rows, "label").select(
        "vec_id", "code", "error", "label_error", codebook_digest(history).alias("codebooks_sha256"))
