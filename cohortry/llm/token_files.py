"""Token-id files with bit- or byte-plane shuffling.

A file holds the ids of consecutive documents, cut into blocks of a fixed number of
ids. A block is transposed into planes (plane ``k`` has byte ``k``, or bit ``k``, of every
id) and each plane is compressed with zstandard. The index at the file's end has the
place, compressed size, id count and checksum of every block, and the documents with
their id counts; so one block or document can be read without the rest.

    header   8 bytes  PLANES01
    blocks            per block its planes one after another
    index             zstandard: JSON header length (4 bytes), JSON header, block table,
                      document ids, presence of the document ids, id counts
    footer  20 bytes  place of the index (8), its size (8), IDX1

Documents are spread by ranges of their id, each task writes one file in the shared
folder, and a table of finished files, the manifest, is written by Spark. Only files in
the manifest count, so tries that failed or ran twice leave nothing that is read.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.arrow_rows import texts_of
from cohortry.llm.bpe import library_encoder, vocabulary_text
from cohortry.llm.registry import documents, query
from cohortry.session import new_folder, staged

MAGIC, END = b"PLANES01", b"IDX1"
BLOCK = 1 << 16
BLOCK_ROW = np.dtype([("at", "<i8"), ("ids", "<i4"), ("crc32", "<u4"), ("sizes", "<i4", (32,))])
MANIFEST = "file_no int, path string, documents long, ids long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of ids, from low to high."""
    columns = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(columns[:, k]).tobytes() for k in range(4)]
    return [np.packbits(columns[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    columns = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            columns[:, k] = raw
        else:
            columns[:, k // 8] |= np.unpackbits(raw, count=n) << (k % 8)
    return columns.reshape(-1).view("<u4")


class Writer:
    """Writes one file to an open binary stream; holds one block at a time."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.kind, self.block = out, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.blocks, self.doc_ids, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(packed) // 4)
        self.waiting.append(packed)
        self.n_waiting += len(packed) // 4
        if self.n_waiting >= self.block:
            joined = b"".join(self.waiting)
            whole = self.n_waiting // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(joined[4 * i:4 * (i + self.block)])
            self.waiting, self.n_waiting = [joined[4 * whole:]], self.n_waiting - whole

    def _put(self, packed: bytes) -> None:
        planes = [self.zip.compress(p) for p in to_planes(np.frombuffer(packed, "<u4"), self.kind)]
        sizes = [len(p) for p in planes] + [0] * (32 - len(planes))
        self.blocks.append((self.at, len(packed) // 4, zlib.crc32(packed), sizes))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_waiting:
            self._put(b"".join(self.waiting))
        head = json.dumps({"planes": self.kind, "blocks": len(self.blocks), "documents": len(self.counts)}).encode()
        index = self.zip.compress(b"".join([
            struct.pack("<i", len(head)), head, np.array(self.blocks, BLOCK_ROW).tobytes(),
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in self.doc_ids], np.uint8).tobytes(),
            np.array(self.counts, "<i8").tobytes()]))
        self.out.write(index + struct.pack("<qq", self.at, len(index)) + END)


class Reader:
    """Reads a file through its index; ``source`` can seek."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        size = source.seek(0, io.SEEK_END)
        size = source.tell() if size is None else size
        source.seek(size - 20)
        at, length, end = struct.unpack("<qq4s", source.read(20))
        if end != END:
            raise ValueError("the file has no index")
        source.seek(at)
        raw = self.unzip.decompress(source.read(length))
        n = struct.unpack_from("<i", raw)[0]
        head = json.loads(raw[4:4 + n])
        self.kind, n_docs, at = head["planes"], head["documents"], 4 + n
        self.blocks = np.frombuffer(raw, BLOCK_ROW, head["blocks"], at)
        at += self.blocks.nbytes
        ids, present = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.counts = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def block(self, k: int) -> bytes:
        row = self.blocks[k]
        sizes = row["sizes"][:4 if self.kind == "byte" else 32]
        self.source.seek(int(row["at"]))
        raw, planes, at = self.source.read(int(sizes.sum())), [], 0
        for size in sizes:
            planes.append(self.unzip.decompress(raw[at:at + size]))
            at += size
        packed = from_planes(planes, int(row["ids"]), self.kind).tobytes()
        if zlib.crc32(packed) != row["crc32"]:
            raise ValueError(f"block {k} is damaged")
        return packed

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(document id, ids before it in the file, its ids), in order; one document is held at a time."""
        held, k, before = bytearray(), 0, 0
        for doc_id, count in zip(self.doc_ids, self.counts.tolist(), strict=True):
            while len(held) < 4 * count:
                held += self.block(k)
                k += 1
            yield doc_id, before, bytes(held[:4 * count])
            del held[:4 * count]
            before += count


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, end_id: int = 2, vocabulary: str | None = None, planes: str = "byte",
          block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs``, write files in ascending order of ``doc_id`` and return the manifest.

    Null and empty texts are the end id alone. Null ids come first; rows that tie on the id
    are in the order of a hash of their text, and then of the text. An empty table gives an
    empty manifest. Other columns are not written. ``folder`` must be one that all executors share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        vocabulary_text(vocabulary or public_tokenizers.path("byte_bpe_50k.json")))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer, stream = library_encoder(shared.value), TaskContext.get().partitionId(), None, None
        where = f"{folder}/{part:07d}-{uuid.uuid4().hex}.ids"
        ids = 0
        for batch in batches:
            if writer is None:
                files, path = _place(where)
                stream = files.open_output_stream(path)
                writer = Writer(stream, planes, block)
            for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                coded = encoder(t) + end
                ids += len(coded) // 4
                writer.add(d, coded)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int32()), "path": [where],
                                              "documents": [len(writer.counts)], "ids": [ids]})

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(*key).sortWithinPartitions(*key, "text"))
    return staged(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), ids.

    ``ids`` holds little-endian unsigned 32-bit integers. Each file is read by one task.
    """
    before = F.coalesce(F.sum("ids").over(
        Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file_no", "path", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = _place(row["path"])
                with filesystem.open_input_file(path) as source:
                    held, size = [], 0
                    for d, at, ids in Reader(source).documents():
                        held.append((d, row["before"] + at, ids))
                        size += len(ids)
                        if size > 8 << 20:
                            yield _batch(held, names)
                            held, size = [], 0
                    if held:
                        yield _batch(held, names)

    # A file a task: rows this small would otherwise be put together in one partition.
    spread = files.repartitionByRange(max(1, manifest.count()), "file_no")
    return spread.mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


@query("op5_token_files")
def _(spark, d):
    manifest = write(documents(spark, d), new_folder(spark, "token-files"))
    return read(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                 F.crc32("ids").alias("ids_crc32"))
