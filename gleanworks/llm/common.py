"""Helpers shared by the training-data operators: scratch tables, components, hashing of words."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed by the output contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="gleanworks-")
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gleanworks-{what}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # only for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def fitted(spark: SparkSession, name: str, fit: Callable[[SparkSession], dict], version: str) -> dict:
    """What ``fit`` returns (JSON values), fitted once for each ``version`` and kept in the shared folder."""
    path = f"{shared_dir(spark)}/gleanworks-models/{name}-{hashlib.sha256(version.encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        model = json.dumps(fit(spark))
        spark.createDataFrame([(model,)], "model string").coalesce(1).write.mode("overwrite").text(path)
        return json.loads(model)
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps: the edge count never grows, and the number of rounds grows with the
    logarithm of the longest path. Each step is an equi-join of two written tables, so that Spark can split the rows
    of a hub over tasks. Null ends and self-loops are dropped; without edges the result is empty.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = scratch.write(e, "edges")
    while not _stars(e):
        both = e.union(e.select("hi", "lo")).toDF("u", "v")
        mins = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-min")
        large = both.where("v > u").join(mins, "u").where("v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = scratch.write(large, "large")
        low = scratch.write(large.groupBy("hi").agg(F.min("lo").alias("m")), "small-min")
        near = large.join(low, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        nxt = scratch.write(near.union(low.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
        scratch.drop(e, mins, large, low)
        e = nxt
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end of another."""
    once = e.groupBy("hi").count().where("count > 1").isEmpty()
    return once and e.join(e.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty()


# --- buckets compared inside tasks --------------------------------------------------------------------------------


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values of ``names``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def earlier_buckets(keys: pa.Array, key: int) -> np.ndarray:
    """A row for each member, a column for each bucket that two or more members share and whose key is below ``key``."""
    member = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
    flat = keys.flatten().to_numpy()
    member, flat = member[flat < key], flat[flat < key]
    _, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[index] > 1
    out = np.zeros((len(keys), int((counts > 1).sum())), np.float32)
    out[member[shared], column[index[shared]]] = 1
    return out


# --- words as 64-bit hashes, by numpy over the bytes of many texts at once ---------------------------------------

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = _RNG.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: About so many bytes of text are hashed at once; a longer text is hashed on its own, whole.
CHUNK_BYTES = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes]):
    """Slices (from, to) of ``texts`` of about CHUNK_BYTES each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct 64-bit hashes of its 5-word shingles, A-Z lower-cased.

    A text of one to four words has one shingle, all its words; one without words has none.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        out += _shingle_chunk(texts[a:b])
    return out


def _word_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where the words of each text begin and end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _BYTE[data] != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word_of = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    place = np.arange(len(data)) - starts[np.maximum(word_of, 0)]
    powers = np.cumprod(np.full(int(place[inside].max()) + 1, _BASE, np.uint64))
    weight = np.where(inside, _BYTE[data] * powers[np.where(inside, place, 0)], np.uint64(0))
    return mix64(np.add.reduceat(weight, starts)), np.concatenate(([0], np.searchsorted(starts, ends)))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after another, A-Z lower-cased, and the number of words of each text."""
    found = [_word_chunk(texts[a:b]) for a, b in chunks(texts)]
    words = np.concatenate([np.empty(0, np.uint64), *(w for w, _ in found)])
    return words, np.concatenate([np.empty(0, np.int64), *(np.diff(b) for _, b in found)])


def _shingle_chunk(texts: list[bytes]) -> list[np.ndarray]:
    words, bounds = _word_chunk(texts)
    if not len(words):
        return [np.empty(0, np.uint64)] * len(texts)
    long_enough = max(len(words) - 4, 0)
    five = np.zeros(long_enough, np.uint64)
    for k in range(5):
        five += words[k : k + long_enough] * _PLACE[k]
    five = mix64(five)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= 5:
            sets.append(np.unique(five[a : b - 4]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            sets.append(mix64(whole))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
