"""Token-id files by bit-plane shuffling.

A file holds the ids of whole documents in order. Ids are cut into blocks of a
fixed size; each block is transposed into bit planes (or byte planes), each
plane is compressed by itself with zstandard, and an index at the end of the
file gives each chunk's place, so that a block can be read alone. A table of
document ids and lengths follows the chunks.

Layout: magic, chunks, document table, index and footer (JSON), length of the
footer, magic.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"TSPLANE1"
#: Ids of a block; a multiple of 8.
BLOCK = 1 << 16
END_ID = 2
#: Ids and documents after which a task begins a new file, whose table of documents
#: and chunk index are held until it is closed.
FILE_IDS, FILE_DOCS = 64 << 20, 1 << 18


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of one block, lowest first; only as many as its largest id needs."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [((ids >> np.uint32(8 * p)) & np.uint32(255)).astype(np.uint8).tobytes() for p in range(-(-width // 8))]
    return [np.packbits(((ids >> np.uint32(p)) & np.uint32(1)).astype(np.uint8)).tobytes() for p in range(width)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for p, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        ids |= part.astype(np.uint32) << np.uint32(8 * p) if kind == "byte" else np.unpackbits(part, count=n).astype(np.uint32) << np.uint32(p)
    return ids


class Writer:
    """Writes one file; holds one block and the document table."""

    def __init__(self, out, kind: str = "bit", block: int = BLOCK, level: int = 3):
        if block % 8 or kind not in ("bit", "byte"):
            raise ValueError("the block size must be a multiple of 8, the kind bit or byte")
        self.out, self.kind, self.block = out, kind, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.pending, self.pending_bytes = len(MAGIC), [], 0
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= 4 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.pending), 4 * self.block
        stop = len(data) if last else len(data) - len(data) % step
        for i in range(0, stop, step):
            ids = np.frombuffer(data[i : min(i + step, stop)], "<u4")
            parts = [self.press.compress(p) for p in to_planes(ids, self.kind)]
            self.chunks.append([self.at, len(ids), [len(p) for p in parts]])
            for p in parts:
                self.out.write(p)
                self.at += len(p)
        self.pending, self.pending_bytes = [data[stop:]], len(data) - stop

    def close(self) -> dict:
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        table = self.press.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes() + null.tobytes())
        self.out.write(table)
        footer = json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks, "docs": len(self.docs), "table": [self.at, len(table)], "ids": self.ids}).encode()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return {"n_docs": len(self.docs), "n_ids": self.ids, "n_bytes": self.at + len(table) + len(footer) + 8 + len(MAGIC)}


class Reader:
    """Reads one file: single blocks by the index, or all documents in order."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        file.seek(size - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<Q", tail[:8])
        file.seek(size - 8 - len(MAGIC) - n)
        self.meta = json.loads(file.read(n))
        self.unpress = zstandard.ZstdDecompressor()

    def docs(self) -> Iterator[tuple[int | None, int]]:
        """Document ids and lengths in file order."""
        at, n = self.meta["table"]
        self.file.seek(at)
        data, k = self.unpress.decompress(self.file.read(n)), self.meta["docs"]
        ids, lengths, null = np.frombuffer(data, "<i8", k), np.frombuffer(data, "<u4", k, 8 * k), np.frombuffer(data, np.uint8, k, 12 * k)
        for i, m, x in zip(ids.tolist(), lengths.tolist(), null.tolist(), strict=True):
            yield None if x else i, m

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.meta["chunks"][k]
        self.file.seek(at)
        planes = [self.unpress.decompress(self.file.read(s)) for s in sizes]
        return from_planes(planes, n, self.meta["kind"])

    def pieces(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """Each document's id, length and its ids in pieces of a block at most.
        The pieces must be read before the next document."""
        k, data, at = 0, b"", 0

        def take(n: int) -> Iterator[bytes]:
            nonlocal k, data, at
            while n:
                if at == len(data):
                    data, at, k = self.block(k).astype("<u4").tobytes(), 0, k + 1
                part = data[at : at + 4 * n]
                at, n = at + len(part), n - len(part) // 4
                yield part

        for doc, n in self.docs():
            yield doc, n, take(n)


def write(docs: DataFrame, out_dir: str, tokenizer: str, kind: str = "bit", block: int = BLOCK, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the ids of all documents (doc_id, text) in ascending doc_id order,
    and returns the manifest: part, number (of the part's files), file, n_docs,
    n_ids, n_bytes, start. A file ends after file_ids ids or file_docs documents.

    Null texts and empty texts hold the end id alone. Null doc_ids come first;
    rows with one doc_id follow one another in the order of a hash of their
    text, so repeats are kept. A text of any length is one document; a text doc_id
    that is no number raises. Other columns are ignored. An empty table gives
    an empty manifest. Files are named by attempt and only those of the manifest
    count, so a task that runs again does no harm.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(common.parallelism(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, number, writer, uri = context.partitionId(), 0, None, ""
        coder, end = tokens.encoder(tokenizer), struct.pack("<I", END_ID)

        def closed() -> pa.RecordBatch:
            done = writer.close()
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "file": [uri], "n_docs": [done["n_docs"]], "n_ids": [done["n_ids"]], "n_bytes": [done["n_bytes"]]})

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode_many(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    uri = f"{out_dir}/part-{part:06d}-{number:05d}-{context.taskAttemptId()}.planes"
                    writer = Writer(common.open_output(uri), kind, block)
                writer.add(doc, ids.tobytes() + end)
                if writer.ids >= file_ids or len(writer.docs) >= file_docs:
                    yield closed()
                    number, writer = number + 1, None
        if writer is not None:
            yield closed()

    manifest = common.stored(dealt.mapInArrow(common.given_back(run), "part long, number long, file string, n_docs long, n_ids long, n_bytes long"), "planes-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32. A task holds one block at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with common.open_input(uri) as file:
                    for doc, n, pieces in Reader(file).pieces():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                        for name, value in zip(out, (doc, start, n, crc), strict=True):
                            out[name].append(value)
                        start += n
                        if len(out["doc_id"]) == 1 << 16:
                            yield _digest(out)
                            out = {name: [] for name in out}
                if out["doc_id"]:
                    yield _digest(out)

    files = manifest.select("file", "start").repartition(common.parallelism(spark))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))
