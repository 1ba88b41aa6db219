"""Arrow-batched helpers shared by the Python operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that an operator holds in Python at once.
ROWS = 1024


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def passed_through(docs: DataFrame, result: list[T.StructField]) -> list[str]:
    """The columns of ``docs`` that a result keeps: all but those it defines itself."""
    own = {f.name for f in result}
    return [c for c in docs.columns if c not in own]


def pack(docs: DataFrame, doc_id: str, text: str, result: list[str]) -> DataFrame:
    """``_id``, ``_text`` and, as the struct ``_others``, all further columns but those named in ``result``.

    Inside an operator no column of the caller then clashes with one of its own, whatever its name.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text, *result)]
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"),
                       F.struct(F.lit(True).alias("_"), *others).alias("_others"))


def unpacked(docs: DataFrame, doc_id: str, text: str, result: list[str], keep_text: bool = False) -> list[Column]:
    """The columns of ``docs`` that :func:`pack` took, in their order, for a select."""
    at = {doc_id: F.col("_id"), text: F.col("_text")}
    names = [c for c in docs.columns if c not in result and (keep_text or c != text)]
    return [at.get(c, F.col(f"_others.`{c}`")).alias(c) for c in names]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``ROWS`` at a time, so that Python holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def add_columns(docs: DataFrame, fields: list[T.StructField],
                start: Callable[[], Callable[[pa.RecordBatch], list]], inputs: list[str],
                keep_inputs: bool = True) -> DataFrame:
    """``docs`` with new columns made batch by batch in Python.

    ``start()`` runs once per task and returns the function from a batch to one list
    per field. A column of ``docs`` that has the name of a new field is replaced. Without
    ``keep_inputs`` the ``inputs`` don't travel back from Python and are not in the result.
    """
    kept = [c for c in passed_through(docs, fields) if keep_inputs or c not in inputs]
    others = [c for c in kept if c not in inputs]
    # Numbered names and one struct on the way to Python and back, as column names there may clash or hold dots.
    given = [F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(inputs)]
    packed = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_others"), *given)
    back = [T.StructField(f"_in{k}", docs.schema[c].dataType) for k, c in enumerate(inputs) if c in kept]
    made_fields = [T.StructField(f"_out{k}", f.dataType) for k, f in enumerate(fields)]
    schema = T.StructType([packed.schema["_others"], *back, *made_fields])
    passed = ["_others", *[f.name for f in back]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, arrow = start(), to_arrow_schema(schema)
        for batch in slices(batches):
            read = pa.RecordBatch.from_arrays([batch.column(f"_in{k}") for k in range(len(inputs))], names=inputs)
            made = [pa.array(v, arrow.field(f.name).type) if not isinstance(v, pa.Array) else v
                    for f, v in zip(made_fields, compute(read), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *made], names=arrow.names)

    at = {c: F.col(f"_others.`{c}`") for c in others} | {c: F.col(f"_in{k}") for k, c in enumerate(inputs)}
    at |= {f.name: F.col(f"_out{k}") for k, f in enumerate(fields)}
    return packed.mapInArrow(run, schema).select(*[at[c].alias(c) for c in [*kept, *[f.name for f in fields]]])
