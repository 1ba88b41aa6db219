"""Packing by power-of-two decomposition.

Each document, with an end id, is cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of the rest from high to low.
Every piece is a sequence of its own, so no sequence crosses documents and none needs
padding. Pieces of equal length form a bucket, which gives batches of one shape: sequences are
numbered bucket by bucket, so a bucket is one range of numbers, and :func:`write_buckets`
writes a folder of files for each.

One pass over the documents and no shuffle: a sequence is numbered by its bucket, its
partition and its place there. The numbers are unique and repeat when a lost task runs
again on the same input split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.llm.arrow_rows import passed_through, texts_of
from cohortry.llm.bpe import library_encoder, vocabulary_text
from cohortry.llm.registry import documents, query

PIECE = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
         T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
#: Bits of a sequence number for the partition and for the place of a piece in its bucket there; the bucket is above.
PARTITION_BITS, PLACE_BITS = 24, 34
#: Pieces per Arrow batch.
BATCH = 4096


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two of at most ``longest`` that sum to ``n``, from high to low."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def bucket_range(length: int) -> tuple[int, int]:
    """The first sequence number of a bucket, and the first behind it."""
    bucket, bits = length.bit_length() - 1, PARTITION_BITS + PLACE_BITS
    return bucket << bits, (bucket + 1) << bits


def decompose(docs: DataFrame, longest: int = 1024, end_id: int = 0, vocabulary: str | None = None,
              text: str = "text") -> DataFrame:
    """One row per piece: the columns of ``docs`` but ``text``, and those of ``PIECE``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``start`` the
    ids of the document before it, ``doc_tokens`` all its ids with the end id. Null and
    empty texts are one piece, the end id. Repeated rows and equal ids are packed each on
    its own; an empty table gives no pieces; columns of ``docs`` with a name of ``PIECE``
    are replaced, all other names are free. A text of any length is cut whole, in the memory of one
    task. ``longest`` must be a power of two below 2^31.
    """
    if not 1 <= longest < 1 << 31 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(
        vocabulary_text(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))
    kept = [c for c in passed_through(docs, PIECE) if c != text]
    packed = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_others"))
    schema = T.StructType([packed.schema["_others"], *PIECE])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, arrow = library_encoder(shared.value), to_arrow_schema(schema)
        partition = TaskContext.get().partitionId()
        if partition >> PARTITION_BITS:
            raise ValueError("too many partitions to number")
        following = [(bucket_range(1 << b)[0]) + (partition << PLACE_BITS) for b in range(longest.bit_length())]
        for batch in batches:
            rows, starts, lengths, ids, totals = [], [], [], [], []

            def flush():
                nonlocal rows, starts, lengths, ids, totals
                sequences = []
                for length in lengths:
                    bucket = length.bit_length() - 1
                    sequences.append(following[bucket])
                    following[bucket] += 1
                made = [starts, lengths, ids, totals, sequences, [0] * len(rows)]
                same = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column("_others").take(same),
                     *[pa.array(v, arrow.field(f.name).type) for v, f in zip(made, PIECE, strict=True)]],
                    names=schema.names)
                rows, starts, lengths, ids, totals = [], [], [], [], []
                return out

            for row, t in enumerate(texts_of(batch, "_text")):
                coded = encoder(t) + end
                start = 0
                for length in piece_lengths(len(coded) // 4, longest):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(coded[4 * start:4 * (start + length)])
                    totals.append(len(coded) // 4)
                    start += length
                if len(rows) >= BATCH:
                    yield flush()
            if rows:
                yield flush()

    pieces = packed.mapInArrow(run, schema)
    return pieces.select(*[F.col(f"_others.`{c}`").alias(c) for c in kept], *[f.name for f in PIECE])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as Parquet, one folder per length."""
    pieces.write.partitionBy("length").parquet(path)


@query("op3_binary_packing")
def _(spark, d):
    pieces = decompose(documents(spark, d).select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
