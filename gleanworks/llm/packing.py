"""Operator 3: cost-balanced packing of documents into sequences of fixed size.

Documents are dealt by hash into groups of bounded text and number, so that no task's work grows with the input, also
where texts are null or rows repeat. Inside a group a
document's full sequences are cut off, and the remainders are placed in descending length, each into the sequence with
the lowest estimated cost (linear plus quadratic in the length of each piece) that has room for it; one that fits
nowhere whole is cut over the lowest-cost sequences with room. A group has the fewest sequences that can hold its
tokens, so padding is under one sequence a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import batches_of, encode

#: Weights of a piece's cost: LINEAR * length + QUADRATIC * length ** 2 (per token and per attended pair).
LINEAR, QUADRATIC = 1.0, 1 / 1024
#: Bytes of text in a group, on average: some thousand sequences. Each row counts as ROW_BYTES more, whatever its text.
GROUP_BYTES, ROW_BYTES = 4_000_000, 400
#: Copies of a repeated row that are numbered at once.
COPIES = 10_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each token of each document is in exactly one."""
    cost_of = lambda n: linear * n + quadratic * n * n
    pieces, full = [], 0
    for d, n in enumerate(lengths):
        for k in range(int(n) // capacity):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
    rest = np.asarray(lengths, np.int64) % capacity
    count = -(-int(rest.sum()) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(lengths[d] - rest[d])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            pieces.append((int(d), start, take, full + s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += cost_of(take)
            left, start = left - take, start + take
    return pieces


def _pack_group(group: int, batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    docs, lengths, streams = [], [], []
    for batch in batches:
        texts = batch.column("text").to_pylist()
        docs += batch.column("doc_id").to_pylist()
        for a, b in batches_of(texts):
            ids, counts = encode(texts[a:b], path)
            ends = np.cumsum(counts)
            streams.append(np.insert(ids, ends, np.uint32(end_id)).astype("<u4"))
            lengths.append(counts + 1)
    if not docs:
        return
    ids, lengths = np.concatenate(streams), np.concatenate(lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))
    pieces = np.array(place(lengths, capacity), np.int64)
    d, start, length, sequence, offset = pieces.T
    crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(first[d] + start, length, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()).take(pa.array(d)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(lengths[d].astype(np.int64)), pa.array((group << 32) + sequence), pa.array(offset)],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces of every row of ``docs(doc_id long, text string, ...)``: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is the ids of its whole text (null: none), however long, and ``end_id``, so each has one piece at least.
    Every id lies in one piece, and the pieces of a sequence fill it from 0 without gaps. sequence_id is the group's number
    times 2**32 plus the sequence's number in the group. Of equally long remainders any may come first. A null doc_id stays
    null; rows that repeat a doc_id, or are the same altogether, are packed as documents of their own; other columns are
    ignored; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES
    each = docs.groupBy("doc_id", F.xxhash64("text")).agg(F.count("*").alias("times"), F.sum(size).alias("bytes"))
    total, most = each.agg(F.sum("bytes"), F.max("times")).first()
    copy = F.lit(0).cast("long")
    if (most or 0) > 1:
        # Equal rows would share a group: they are counted, then numbered. Retried tasks give the same rows again.
        docs = docs.groupBy("doc_id", "text").agg(F.count("*").alias("times"))
        docs = docs.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long"))))
        docs = docs.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "times") - 1)))
        copy = F.col("copy")
    groups = max(1, -(-(total or 0) // group_bytes))
    docs = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", copy), F.lit(groups)).alias("g"))

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack_group(key[0].as_py(), batches, path, end_id, capacity)

    return docs.groupBy("g").applyInArrow(work, PIECES)
