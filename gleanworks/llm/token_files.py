"""Operator 9: token ids in binary shards, bit planes shuffled and compressed, with a chunk index.

A shard holds the ids of documents in ascending doc_id order as one stream. The stream is cut into chunks of 65 536 ids;
a chunk's 32-bit ids are transposed into planes (bit planes, or byte planes), and each plane is a zstandard frame of its
own, so that planes of zeros cost a few bytes. Layout, all integers little-endian:

    magic GWTOKEN1 | planes of chunk 0, chunk 1, ... | index | index offset u64, index size u64, magic

The index is one zstandard frame: u32 plane kind (1 or 8 bits), u32 planes a chunk, u64 chunks, u64 documents, then per
chunk u64 offset and u32 ids, per chunk and plane u32 size, per document i64 doc_id (minimum: null) and u64 ids.

Shards are written by tasks into the shared folder under names of their own; only the rows of tasks that ended are in
the manifest, so a task that is retried or doubled leaves at most a file that nothing names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import batches_of, encode

MAGIC = b"GWTOKEN1"
CHUNK = 65_536
NULL_ID = -(2**63)
LEVEL = 3
#: Bytes of text in a shard, fewer where there would be fewer shards than shuffle partitions; the most shards.
SHARD_BYTES, LEAST_BYTES, MAX_SHARDS = 256_000_000, 4_000_000, 50_000
MANIFEST = "shard long, path string, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of 1 or 8 bits, the lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [octets[:, k].tobytes() for k in range(4)]
    return [np.packbits((octets[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if bits == 8:
            octets[:, k] = raw
        else:
            octets[:, k // 8] |= np.unpackbits(raw, count=n) << np.uint8(k % 8)
    return octets.reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, bits: int = 1, level: int = LEVEL):
        self.out, self.bits, self.zstd = out, bits, zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.chunks, self.sizes, self.doc_ids, self.counts = [], [], [], []
        out.write(MAGIC)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, their ids one after another."""
        self.doc_ids += [NULL_ID if d is None else d for d in doc_ids]
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= CHUNK:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // CHUNK * CHUNK
            for a in range(0, whole, CHUNK):
                self._chunk(stream[a : a + CHUNK])
            self.waiting, self.n_waiting = [stream[whole:]], len(stream) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.out.write(b"".join(frames))
        self.chunks.append((self.at, len(ids)))
        self.sizes.append([len(f) for f in frames])
        self.at += sum(self.sizes[-1])

    def close(self) -> int:
        """Write what waits and the index; the bytes of the file."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        table = np.array(self.chunks, np.uint64).reshape(-1, 2)
        index = struct.pack("<IIQQ", self.bits, 32 // self.bits, len(self.chunks), len(self.doc_ids)) + b"".join(
            x.tobytes() for x in (table[:, 0].astype("<u8"), table[:, 1].astype("<u4"), np.array(self.sizes, "<u4"), np.array(self.doc_ids, "<i8"), np.array(self.counts, "<u8"))
        )
        frame = self.zstd.compress(index)
        self.out.write(frame + struct.pack("<QQ", self.at, len(frame)) + MAGIC)
        return self.at + len(frame) + 16 + len(MAGIC)


class ShardReader:
    def __init__(self, source):
        """source: a seekable binary file (``pyarrow.NativeFile``)."""
        self.source = source
        source.seek(source.size() - 24)
        tail = source.read(24)
        if tail[16:] != MAGIC:
            raise ValueError("not a token shard")
        at, size = struct.unpack("<QQ", tail[:16])
        source.seek(at)
        index = zstandard.ZstdDecompressor().decompress(source.read(size))
        self.bits, planes, n_chunks, n_docs = struct.unpack_from("<IIQQ", index)
        shapes, at, found = (("<u8", n_chunks), ("<u4", n_chunks), ("<u4", n_chunks * planes), ("<i8", n_docs), ("<u8", n_docs)), 24, []
        for kind, n in shapes:
            found.append(np.frombuffer(index, kind, n, at))
            at += found[-1].nbytes
        self.offsets, self.chunk_ids, self.sizes, self.doc_ids, counts = found
        self.sizes, self.counts = self.sizes.reshape(n_chunks, planes), counts.astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        raw, unzip, planes, at = self.source.read(int(self.sizes[k].sum())), zstandard.ZstdDecompressor(), [], 0
        for size in self.sizes[k].tolist():
            planes.append(unzip.decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, int(self.chunk_ids[k]), self.bits)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n of the stream, from the chunks that hold them."""
        if n == 0:
            return np.empty(0, "<u4")
        a, b = first // CHUNK, (first + n - 1) // CHUNK
        return np.concatenate([self.chunk(k) for k in range(a, b + 1)])[first - a * CHUNK :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, number of ids, runs of its ids), each chunk decoded once; take the runs before the next document."""
        k, held = 0, np.empty(0, "<u4")

        def runs(n: int) -> Iterator[np.ndarray]:
            nonlocal k, held
            while n:
                if not len(held):
                    held, k = self.chunk(k), k + 1
                yield held[:n]
                n, held = n - min(n, len(held)), held[n:]

        for d, n in zip(self.doc_ids.tolist(), self.counts.tolist(), strict=True):
            yield None if d == NULL_ID else d, n, runs(n)


def write_shards(docs: DataFrame, out_dir: str, path: str | None = None, end_id: int = 2, bits: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` into shards under ``out_dir`` (a URI that pyarrow opens, shared by all
    executors); the manifest (shard, path, n_docs, n_ids, n_bytes), whose shards ascend by doc_id.

    Null texts are empty; each document ends with ``end_id``. Null doc_ids come first. Rows that repeat a doc_id are
    documents of their own, ordered by text; equal rows are alike. Whole texts are written, however long. The number of
    shards follows from the size of the texts. Other columns are ignored. An empty table gives an empty manifest.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    scratch = scratch or Scratch(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = n_ids = 0
        for batch in batches:
            texts, ids_of = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in batches_of(texts):
                if not writer:
                    shard = TaskContext.get().partitionId()
                    fs, folder = pa.fs.FileSystem.from_uri(out_dir)
                    fs.create_dir(folder, recursive=True)
                    name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.gwt"
                    out = fs.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(out, bits)
                ids, counts = encode(texts[a:b], path)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                writer.add(ids_of[a:b], counts + 1, ids)
                n_ids += len(ids)
        if writer:
            n_bytes = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out_dir}/{name}"], "n_docs": [len(writer.doc_ids)], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(-(-size // LEAST_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = min(MAX_SHARDS, max(1, least, -(-size // SHARD_BYTES)))
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return scratch.write(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark: SparkSession = manifest.sparkSession
    starts, at = [], 0
    for r in manifest.orderBy("shard").toLocalIterator():  # one row for each file
        starts.append((r.shard, r.path, at))
        at += r.n_ids
    shards = spark.createDataFrame(starts, "shard long, path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, file = pa.fs.FileSystem.from_uri(row["path"])
                at, found = row["start"], []
                with fs.open_input_file(file) as source:
                    for d, n, runs in ShardReader(source).documents():
                        crc = 0
                        for ids in runs:
                            crc = zlib.crc32(ids.tobytes(), crc)
                        found.append((d, at, n, crc))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartitionByRange(max(1, len(starts)), "shard").mapInArrow(read, DOCUMENTS)
