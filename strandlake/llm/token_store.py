"""Token-id files: blocks of ids as bit or byte planes, each compressed with zstandard, under a chunk index.

A file holds the documents of one task in ascending order. Layout::

    "TIDPLANE" | planes of block 0 | planes of block 1 | ... | footer | footer size u64 | "TIDPLANE"

The footer is zstandard-compressed: u32 kind (1 bit, 8 byte), u32 ids a block, u64 blocks, u64 documents,
u64 ids; per block u64 offset, u32 ids and a u32 size for each plane; per document u64 doc_id, u8 null flag and
u32 ids. An id is 32 bits, so a block has 32 bit planes or 4 byte planes, lowest first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, open_fs, shared_dir, stored, tune
from .token_cache import tokenizer

MAGIC = b"TIDPLANE"
HEAD = struct.Struct("<IIQQQ")
BLOCK_IDS = 1 << 16
MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
IDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first: bit planes for bits = 1, byte planes for bits = 8."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, i].tobytes() for i in range(4)]
    flags = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flags[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ids of a block from its planes."""
    if bits == 8:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    """Writes documents' ids to an open binary stream; holds one block and the index in memory."""

    def __init__(self, sink, bits: int = 8, block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting, self.waits, self.blocks, self.docs, self.n_ids = [], 0, [], [], 0
        self.at = sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.waits += len(ids) // 4
        if self.waits >= self.block_ids:
            every = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(every) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i : i + self.block_ids])
            self.waiting, self.waits = [every[whole:].tobytes()], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.sink.write(p)
        self.at += sum(map(len, planes))

    def close(self) -> int:
        """Write what is left and the footer; the file's size."""
        if self.waits:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        rows = np.array(self.blocks, "<u8").reshape(len(self.blocks), -1)
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([n for _, n in self.docs], "<u4")
        head = HEAD.pack(self.bits, self.block_ids, len(self.blocks), len(self.docs), self.n_ids)
        footer = self.zip.compress(head + b"".join([rows[:, :1].tobytes(), rows[:, 1:].astype("<u4").tobytes()] if len(rows) else []) + ids.tobytes() + nulls.tobytes() + sizes.tobytes())
        tail = footer + struct.pack("<Q", len(footer)) + MAGIC
        self.sink.write(tail)
        return self.at + len(tail)


class PlaneReader:
    """Random access to a token-id file through its chunk index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id file, or one that was cut short")
        n = struct.unpack("<Q", tail[:8])[0]
        source.seek(size - 16 - n)
        raw = zstandard.ZstdDecompressor().decompress(source.read(n))
        self.bits, self.block_ids, blocks, docs, self.n_ids = HEAD.unpack_from(raw)
        planes, at = 32 // self.bits, HEAD.size
        self.offsets = np.frombuffer(raw, "<u8", blocks, at)
        at += 8 * blocks
        table = np.frombuffer(raw, "<u4", blocks * (planes + 1), at).reshape(blocks, -1)
        self.lengths, self.sizes = table[:, 0], table[:, 1:]
        at += table.nbytes
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.n_tokens = np.frombuffer(raw, "<u4", docs, at + 9 * docs)

    def block(self, i: int) -> np.ndarray:
        self.source.seek(int(self.offsets[i]))
        unzip, planes = zstandard.ZstdDecompressor(), []
        raw = self.source.read(int(self.sizes[i].sum()))
        for n in self.sizes[i].tolist():
            planes.append(unzip.decompress(raw[:n]))
            raw = raw[n:]
        return from_planes(planes, int(self.lengths[i]), self.bits)

    def documents(self):
        """(doc_id, number of ids, iterator of the ids' parts) in the file's order; one block is held at a time."""
        state = {"block": -1, "ids": np.empty(0, "<u4"), "at": 0}

        def parts(left: int):
            while left:
                if state["at"] == len(state["ids"]):
                    state["block"] += 1
                    state["ids"], state["at"] = self.block(state["block"]), 0
                got = state["ids"][state["at"] : state["at"] + left]
                state["at"] += len(got)
                left -= len(got)
                yield got

        for d, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.n_tokens.tolist(), strict=True):
            yield None if null else d, n, parts(n)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, bits: int = 8) -> DataFrame:
    """Encode docs (doc_id, text) and write them to token-id files in ascending doc_id order.

    Returns the manifest: a row per file with its place in the order (``part``), documents, ids and
    ``first_id``, the ids in files before it. Only files in the manifest count: an attempt that was lost or
    repeated leaves a file that no reader opens.

    A null or empty text is the end id alone. Documents without a doc_id come first; rows that repeat a
    doc_id are documents of their own, one after another. An empty table gives an empty manifest. Columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    end = struct.pack("<I", end_id)

    def write(batches):
        code, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        files, where = open_fs(path)
        files.create_dir(where, recursive=True)
        name, writer = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}.tid", None
        for b in batches:
            if writer is None:
                sink = files.open_output_stream(f"{where}/{name}", compression=None)
                writer = PlaneWriter(sink, bits)
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                writer.add(d, code.encode(t.as_py()) + end)
        if writer:
            size = writer.close()
            sink.close()
            yield arrow_rows(MANIFEST, path=[f"{path}/{name}"], part=[part], n_docs=[len(writer.docs)], n_ids=[writer.n_ids], n_bytes=[size])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id"), key).sortWithinPartitions(F.col("doc_id"), key, F.col("text"))
    manifest = stored(dealt.mapInArrow(write, "path string, part long, n_docs long, n_ids long, n_bytes long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _each_document(manifest: DataFrame, schema: str, rows) -> DataFrame:
    """A task for each file; rows(reader, first id) yields record batches."""

    def read(batches):
        for b in batches:
            for path, size, first in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                files, where = open_fs(path)
                with files.open_input_file(where) as source:
                    yield from rows(PlaneReader(source, size), first)

    files = manifest.select("path", "n_bytes", "first_id").withColumn("_deal", F.xxhash64("path"))
    n = max(1, manifest.count())
    return files.repartition(n, "_deal").drop("_deal").mapInArrow(read, schema)


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document in all files) and its ids, read from the files."""

    def rows(reader, start):
        for d, n, parts in reader.documents():
            yield arrow_rows(IDS, doc_id=[d], start=[start], ids=[[x for p in parts for x in p.tolist()]])
            start += n

    return _each_document(manifest, "doc_id long, start long, ids array<long>", rows)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the ids in the files; a block is held at a time."""

    def rows(reader, start):
        out = []
        for d, n, parts in reader.documents():
            crc = 0
            for p in parts:
                crc = zlib.crc32(p.tobytes(), crc)
            out.append((d, start, n, crc))
            start += n
            if len(out) == 4096:
                yield arrow_rows(DIGEST, **dict(zip(DIGEST.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield arrow_rows(DIGEST, **dict(zip(DIGEST.names, zip(*out, strict=True), strict=True)))

    return _each_document(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", rows)


def token_binary(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, bits: int = 8, path: str | None = None) -> DataFrame:
    """Write docs to token-id files under ``path`` (by default in shared storage) and read their digests back."""
    return read_digests(write_ids(docs, path or shared_dir(spark, "token-ids"), vocabulary, end_id, bits))
