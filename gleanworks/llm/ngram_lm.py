"""Operator 13: texts scored by an n-gram model with deleted interpolation.

The model mixes maximum-likelihood estimates of every order, and a smoothed unigram estimate at the bottom, with weights that
depend on how often the context was seen. The weights are learned by expectation-maximisation on a deleted part of the
training documents, with counts of the rest; the counts of the final model are those of all training documents.

Documents are tokenised once, into chunks of some megabytes of text, a row each. A chunk asks once for the count of each
distinct n-gram that it holds, whatever their number in the text, so a frequent n-gram costs a row per chunk and not per
document. What it asks travels as sorted, compressed runs of keys, a run for each range of keys; the task of a range adds up
what all chunks have and answers every run with counts in its order. Every n-gram of the corpus is counted, none is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hashed_words, mix64

#: Highest order, at most 5; one training document in so many is deleted while the weights are learned.
ORDER, FOLDS = 2, 8
#: The fold of documents that are held out of training altogether, of so many.
HELD_OUT, OUT_OF = 2, 7
#: Bytes of text in a chunk, and in the texts for each range of keys.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 16_000_000
#: Tokens of a chunk that are worked on at once.
SLICE = 1 << 16
ROUNDS, TOLERANCE = 25, 1e-6
#: Buckets of contexts: the order of the longest context seen, and the binary logarithm of its count.
SIZES = 64
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PLACES = mix64(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)
CHUNK = "chunk long, deleted boolean, kept_tokens long, deleted_tokens long, doc_ids array<long>, held_out array<boolean>, learn array<boolean>, sizes binary, vocabulary binary, ids binary"
RUN = "range int, chunk long, deleted boolean, n int, single binary, keys binary, counts binary"
ANSWER = "chunk long, range int, deleted boolean, kept binary, total binary, v_kept long, v_all long"
EM_ROW = "bucket int, p array<double>, n long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with return_inverse, with 32-bit places and about half its memory."""
    order = np.argsort(a)
    found = a[order]
    first = np.concatenate((found[:1] == found[:1], found[1:] != found[:-1]))
    found = found[first]
    rank = np.cumsum(first, dtype=np.int32)
    rank -= 1
    at = np.empty(len(a), np.int32)
    at[order] = rank
    return found, at


def packed(a: np.ndarray) -> bytes:
    """Numbers as byte planes, the lowest first, in one zstandard frame: planes of zeros cost nothing."""
    out = zstandard.ZstdCompressor(level=1).compressobj(size=8 * len(a))
    return b"".join([*(out.compress(((a >> a.dtype.type(8 * i)) & a.dtype.type(255)).astype(np.uint8).tobytes()) if i < a.itemsize else out.compress(bytes(len(a))) for i in range(8)), out.flush()])


def unpacked(frame: bytes, kind: type = np.uint64) -> np.ndarray:
    """``kind`` may be narrower than what was packed, where the numbers fit."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(8, -1)
    out = np.empty((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    for i in range(out.shape[1]):
        out[:, i] = raw[i]
    return out.view(np.dtype(kind).newbyteorder("<")).ravel()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the number of tokens of each text."""
    words, counts = hashed_words(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes)
    tokens = np.full(int(ends[-1]) if len(ends) else 0, _END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = words
    return tokens, sizes


class NGrams:
    """The n-grams of a chunk: for each order its distinct keys and, for each token, which of them ends there."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int):
        self.sizes, self.order = sizes, order
        self.firsts = np.cumsum(sizes) - sizes
        tokens = vocabulary[ids]
        self.keys, self.at = [mix64(vocabulary * _PLACES[0] + np.uint64(1))], [ids]
        for k in range(2, order + 1):
            total = tokens * _PLACES[0]
            total += np.uint64(k)
            for j in range(1, k):
                for a in range(j, len(total), SLICE):
                    total[a : a + SLICE] += tokens[a - j : a - j + SLICE][: len(total) - a] * _PLACES[j]
                # what stands before a text are start marks: a text's first j tokens are mended
                for i in range(j):
                    at = self.firsts[sizes > i] + i
                    total[at] += (_START - tokens[np.maximum(at - j, 0)] * (at >= j)) * _PLACES[j]
            for a in range(0, len(total), SLICE):
                total[a : a + SLICE] = mix64(total[a : a + SLICE])
            keys, at = distinct(total)
            self.keys.append(keys), self.at.append(at)
            del total, at
        del tokens
        #: Contexts of start marks alone, which end at no token.
        marks = [mix64(np.array([sum((int(_START) * int(_PLACES[j]) for j in range(k)), k) % 2**64], np.uint64)) for k in range(1, order)]
        every = np.concatenate([*self.keys, *marks])
        self.sorted = np.argsort(every, kind="stable").astype(np.int32)
        self.every = every[self.sorted]
        self.cuts = np.cumsum([len(k) for k in self.keys])

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """Of the keys in order, in the texts that ``learn`` marks."""
        weight = np.repeat(learn, self.sizes).astype(np.float64)
        sums = [np.bincount(at, weights=weight, minlength=len(k)) for k, at in zip(self.keys, self.at, strict=True)]
        return np.concatenate([*sums, np.full(self.order - 1, learn.sum())])[self.sorted].astype(np.int64)

    @property
    def single(self) -> np.ndarray:
        """Which of the keys in order are tokens."""
        return self.sorted < self.cuts[0]

    def found(self, counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each order the counts of the n-gram at each token, and of its context, from counts of the keys in order."""
        back = np.empty_like(counts)
        back[self.sorted] = counts
        of = [c[at] for c, at in zip(np.split(back[: self.cuts[-1]], self.cuts[:-1]), self.at, strict=True)]
        contexts = []
        for k in range(1, self.order):
            c = np.concatenate(([0], of[k - 1][:-1]))
            c[self.firsts] = back[self.cuts[-1] + k - 1]
            contexts.append(c)
        return of, contexts

    def drop_keys(self) -> None:
        """Keep the texts' places alone, once counts are found."""
        self.keys = self.at = self.every = self.sorted = None


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that follow one another, with about a sixteenth of a chunk's bytes of text or one longer text."""
    sizes = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
    of = (np.cumsum(sizes) - sizes) // max(CHUNK_BYTES // 16, 1)
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else of
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the documents of a partition, those of the deleted part apart. Texts become tokens a slice at a time, so that a
    task holds no more of a batch than the batch itself."""
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    made = 0

    def chunk(deleted: bool) -> pa.RecordBatch:
        nonlocal made
        rows, tokens, sizes = zip(*held[deleted], strict=True)
        held[deleted], size[deleted] = [], 0
        doc_ids, held_out, learn = (pa.concat_arrays([r.column(n) for r in rows]).to_pylist() for n in ("doc_id", "held_out", "learn"))
        tokens, sizes = np.concatenate(tokens), np.concatenate(sizes)
        vocabulary, ids = distinct(tokens)
        del tokens
        learned = int(sizes[np.array(learn, bool)].sum())
        number = (TaskContext.get().partitionId() << 32) + made
        made += 1
        row = [number, deleted, 0 if deleted else learned, learned if deleted else 0, doc_ids, held_out, learn, packed(sizes), packed(vocabulary), packed(ids)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in CHUNK.split(", ")])

    for batch in batches:
        for rows in _slices(batch):
            tokens, sizes = _tokens(rows.column("text").to_pylist())
            is_deleted = rows.column("is_deleted").to_numpy(zero_copy_only=False)
            lengths = pc.binary_length(rows.column("text")).to_numpy()
            for deleted in (False, True):
                mine = is_deleted == deleted
                if mine.any():
                    held[deleted].append((rows.select(["doc_id", "held_out", "learn"]).filter(pa.array(mine)), tokens[np.repeat(mine, sizes)], sizes[mine]))
                    size[deleted] += int(lengths[mine].sum())
                if size[deleted] >= CHUNK_BYTES:
                    yield chunk(deleted)
    for deleted in held:
        if held[deleted]:
            yield chunk(deleted)


def _opened(row: dict, order: int) -> NGrams:
    return NGrams(unpacked(row["vocabulary"]), unpacked(row["ids"], np.int32), unpacked(row["sizes"], np.int64), order)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges ascend with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _runs(batches: Iterator[pa.RecordBatch], order: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """What each chunk asks: its n-grams by range, the keys as differences, and its own counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            grams = _opened(row, order)
            keys, counts, single = grams.every, grams.counts(np.array(row["learn"], bool)), grams.single
            of = _range_of(keys, ranges)
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                steps = np.diff(keys[a:b], prepend=np.uint64(0))
                found.append((int(of[a]), row["chunk"], row["deleted"], b - a, np.packbits(single[a:b]).tobytes(), packed(steps), packed(counts[a:b])))
            del grams, keys, counts, single, of, row
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RUN.split(", ")])


def _answered(table: pa.Table) -> pa.Table:
    """Counts of all chunks for the runs of one range, in the order of each run; and how many single tokens there are."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(unpacked(r["keys"]), dtype=np.uint64) for r in rows])
    counts = np.concatenate([unpacked(r["counts"]) for r in rows]).astype(np.int64)
    single = np.concatenate([np.unpackbits(np.frombuffer(r["single"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    deleted = np.repeat([r["deleted"] for r in rows], [r["n"] for r in rows])
    found, index = distinct(keys)
    many = len(found)
    del keys, found
    of = lambda which: np.bincount(index[which], weights=counts[which], minlength=many).astype(np.int64)
    kept = of(~deleted)
    total = kept + of(deleted)
    word = np.zeros(many, bool)
    word[index[single]] = True
    ends = np.cumsum([r["n"] for r in rows])
    slices = [index[e - r["n"] : e] for e, r in zip(ends, rows, strict=True)]
    known = [int((word & (c > 0)).sum()) for c in (kept, total)]
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "range": pa.array([r["range"] for r in rows], pa.int32()), "deleted": [r["deleted"] for r in rows],
        "kept": pa.array([packed(kept[x]) if r["deleted"] else None for x, r in zip(slices, rows, strict=True)], pa.binary()), "total": pa.array([packed(total[x]) for x in slices], pa.binary()),
        "v_kept": pa.array([known[0]] + [0] * (len(rows) - 1), pa.int64()), "v_all": pa.array([known[1]] + [0] * (len(rows) - 1), pa.int64()),
    })


def _estimated(chunk: pa.Table, answers: pa.Table, counts: str, order: int, n: int, v: int) -> tuple[dict, NGrams, np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """(the chunk, its n-grams, counts of its tokens, the bucket of each one's context, its estimates of an order; 0 is the
    smoothed one of unigrams), from the counts that the chunk was answered. Estimates are made when they are asked for, so
    that a task need not hold those of all orders."""
    row = chunk.to_pylist()[0]
    grams = _opened(row, order)
    frames = answers.sort_by("range").column(counts).to_pylist()
    of, contexts = grams.found(np.concatenate([unpacked(x, np.int64) for x in frames]))
    grams.drop_keys()
    del frames
    single = of[0]
    bucket = np.full(len(single), SIZES if n else 0, np.int32)
    for k, seen in enumerate(contexts, 2):
        bucket = np.where(seen > 0, k * SIZES + np.log2(np.maximum(seen, 1)).astype(np.int32), bucket)

    def p(k: int) -> np.ndarray:
        if k == 0:
            return (single + 1) / (n + v + 1)
        if k == 1:
            return single / max(n, 1)
        seen = contexts[k - 2]
        return np.where(seen > 0, of[k - 1] / np.maximum(seen, 1), 0.0)

    return row, grams, single, bucket, p


def _em_rows(chunk: pa.Table, answers: pa.Table, order: int, n: int, v: int) -> pa.Table:
    """The tokens of a deleted chunk by bucket and estimates, those that are alike counted together."""
    _, _, _, bucket, p = _estimated(chunk, answers, "kept", order, n, v)
    alike = bucket.astype(np.uint64)
    for k in range(order + 1):
        alike = mix64(alike + p(k).view(np.uint64))
    _, at, counts = np.unique(alike, return_index=True, return_counts=True)
    listed = pa.ListArray.from_arrays(np.arange(0, len(at) * (order + 1) + 1, order + 1, dtype=np.int32), np.stack([p(k)[at] for k in range(order + 1)], axis=1).ravel())
    return pa.table({"bucket": bucket[at].astype(np.int32), "p": listed, "n": counts.astype(np.int64)})


def _scores(chunk: pa.Table, answers: pa.Table, order: int, n: int, v: int, weights: np.ndarray) -> pa.Table:
    row, grams, single, bucket, p = _estimated(chunk, answers, "total", order, n, v)
    base = np.log10(p(0))
    mixed = np.zeros(len(base))
    for k in range(order + 1):
        mixed += weights[bucket, k] * p(k)
    total = lambda x: np.add.reduceat(x, grams.firsts)  # noqa: E731  a text has its end token at least
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": row["held_out"], "n_tokens": grams.sizes, "n_known": total((single > 0).astype(np.int64)), "base_score": total(base), "score": total(np.log10(mixed))})


def start_weights(order: int) -> np.ndarray:
    """(bucket, order) weights before learning: even over the orders whose context was seen."""
    out = np.zeros(((order + 1) * SIZES, order + 1))
    for b in range(len(out)):
        out[b, : b // SIZES + 1] = 1 / (b // SIZES + 1)
    return out


def learn_weights(rows: DataFrame, order: int) -> np.ndarray:
    """Expectation-maximisation over ``rows(bucket, p, n)``, each round one aggregation to a row per bucket.

    The smoothed unigrams keep the share of one more token in every bucket, so that no text has probability 0. A bucket that
    no deleted token falls into takes the weights of the nearest bucket of its order that has some.
    """
    weights, last = start_weights(order), -math.inf
    seen: set[int] = set()
    for _ in range(ROUNDS):
        table = F.split(F.lit(",".join(map(repr, weights.ravel().tolist()))), ",").cast("array<double>")
        part = [F.element_at("p", j + 1) * F.get(table, F.col("bucket") * (order + 1) + j) for j in range(order + 1)]
        each = rows.select("bucket", "n", *(x.alias(f"x{j}") for j, x in enumerate(part)))
        mixed = sum((F.col(f"x{j}") for j in range(1, order + 1)), F.col("x0"))
        shares = [F.sum(F.col("n") * F.col(f"x{j}") / F.col("mixed")).alias(f"s{j}") for j in range(order + 1)]
        found = each.withColumn("mixed", mixed).groupBy("bucket").agg(F.sum(F.col("n") * F.log("mixed")).alias("fit"), *shares).collect()  # a row for each bucket
        for r in found:
            share = np.array([r[f"s{j}"] for j in range(order + 1)])
            share[0] += 1
            weights[r.bucket] = share / share.sum()
            seen.add(r.bucket)
        fit = sum(r.fit for r in found)
        if not found or fit - last <= TOLERANCE * abs(fit):
            break
        last = fit
    for b in range(len(weights)):
        near = [x for x in seen if x // SIZES == b // SIZES]
        if b not in seen and near:
            weights[b] = weights[min(near, key=lambda x: (abs(x - b), x))]
    return weights


def remainder(doc_id: Column, m: int = OUT_OF) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def score_texts(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z are lower-cased; tokens are runs of anything but ASCII white space, known by 64-bit hashes, and one end. A null or
    empty text is its end token. A null doc_id is neither held out nor learned from; rows that repeat a doc_id or a text are
    texts of their own. Without training documents base and model are uniform; without a deleted part the weights are even.
    Whole texts count, however long; other columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= order <= 5:
        raise ValueError("order is 1 to 5")
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-lm")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(crc % OUT_OF == HELD_OUT, F.lit(False))
    learn = F.col("doc_id").isNotNull() & ~held_out
    deleted = learn & F.coalesce(F.floor(crc / OUT_OF) % folds == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"), learn.alias("learn"), deleted.alias("is_deleted"))
    chunks = scratch.write(rows.mapInArrow(_chunked, CHUNK), "chunks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    runs = chunks.select("chunk", "deleted", "learn", "sizes", "vocabulary", "ids").mapInArrow(lambda b: _runs(b, order, ranges), RUN)
    answers = scratch.write(runs.groupBy("range").applyInArrow(_answered, ANSWER), "answers")
    n_kept, n_deleted = chunks.agg(F.coalesce(F.sum("kept_tokens"), F.lit(0)), F.coalesce(F.sum("deleted_tokens"), F.lit(0))).first()
    v_kept, v_all = answers.agg(F.coalesce(F.sum("v_kept"), F.lit(0)), F.coalesce(F.sum("v_all"), F.lit(0))).first()
    n_all = n_kept + n_deleted

    in_chunk = lambda df, *columns: df.select("chunk", *columns).groupBy("chunk")
    em = in_chunk(chunks.where("deleted"), "sizes", "vocabulary", "ids").cogroup(in_chunk(answers.where("deleted"), "range", "kept"))
    em = em.applyInArrow(lambda c, a: _em_rows(c, a, order, n_kept, v_kept), EM_ROW)
    em = scratch.write(em.groupBy("bucket", "p").agg(F.sum("n").alias("n")), "deleted")
    weights = learn_weights(em, order)
    found = in_chunk(chunks, "doc_ids", "held_out", "sizes", "vocabulary", "ids").cogroup(in_chunk(answers, "range", "total"))
    found = found.applyInArrow(lambda c, a: _scores(c, a, order, n_all, v_all, weights), SCORED)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
