"""Operator 7: near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Equal vectors of a label collapse to one class first. On a bounded sample of vectors, rotations are learned that make
balanced binary codes of small quantisation error (iterative quantisation, several starts). The code is cut into
substrings, one Hamming table each; classes of one label that agree on a substring meet, and the original vectors decide.

Codes are those of residuals. Vectors meet within their label only, so each label that the sample knows well has a centre
of its own, its sample's mean; the others share the mean of the whole sample. How often two linked vectors agree on a bit
follows from geometry, not from the data: vectors at the threshold are at most ``delta`` apart, so that seen from their
centre their directions differ by at most asin(delta / r), r being the larger of their distances from it. Vectors nearer to
the centre than RADIUS, where codes say little about neighbours, are a bucket of their own; all other links have an
agreement that sets the number of tables for a miss rate of MISS each.

Small buckets give pairs, of which a 64-bit part of the code discards most by its Hamming distance. The members of large
ones are compared in blocks inside tasks: these return counts of links and a spanning forest, never pairs, so that a
dense group costs multiplications of matrices and few rows. A task reads two blocks and compares them tile by tile: its
memory is that of the two and of one tile, and a vector is sent once for each block of its bucket. Where a label's large buckets together take more
comparisons than all their members among each other, the members are compared once instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, earlier_buckets, groups

#: The bound of the training sample, in vectors.
SAMPLE = 5000
ITERATIONS = 20
MISS = 3e-4
MIN_BITS, MAX_BITS = 10, 30
#: Vectors nearer to their centre are compared without codes: their links agree on fewer than 4 bits in 5.
RADIUS = 0.6
#: Labels with at least so many vectors in the sample have a centre of their own.
KNOWN = 25
#: Buckets of at most so many members give pairs.
SMALL = 16
#: Numbers in the vectors of a block; buckets of more than FEW members are dealt to SPREAD blocks at least where each gets
#: so many, so that one bucket keeps several tasks busy. TILE vectors of one block meet TILE of another at once.
BLOCK_NUMBERS, FEW, SPREAD, TILE = 2**21, 128, 8, 2048


class Codes:
    """Learned centres and rotations, the substring length, the number of tables, and the Hamming distance that a link can
    have."""

    def __init__(self, sample: np.ndarray, labs: np.ndarray, threshold: float, label_size: float, seed: int = 7):
        """labs: the label of each sample vector, as a number; label_size: the mean size of a vector's label, in classes."""
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        found, counts = np.unique(labs, return_counts=True)
        #: Sorted labels with a centre of their own; the last centre is that of all others.
        self.known = found[counts >= KNOWN]
        self.centres = np.stack([*(unit[labs == lab].mean(axis=0) for lab in self.known), unit.mean(axis=0)])
        centred = unit - self.centres[self._place(labs)]
        self.bits = int(min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(label_size, 2))))))
        delta = math.sqrt(max(2 - 2 * threshold, 0))
        #: Vectors nearer to their centre go to the label's inner bucket.
        self.inner = max(RADIUS, 0.98 * float(np.linalg.norm(centred, axis=1).min()))
        differ = math.asin(min(1.0, delta / self.inner)) / math.pi
        self.tables = max(4, math.ceil(math.log(MISS) / math.log1p(-((1 - differ) ** self.bits))))
        rotations = []
        while len(rotations) * self.dim < max(self.tables * self.bits, 64):
            rotations.append(self._rotation(centred, rng))
        self.rotation = np.concatenate(rotations, axis=1).astype(np.float32)
        self.radius = 64 if self.dim < 16 else min(64, math.ceil(64 * differ + 6 * math.sqrt(64 * differ * (1 - differ))))

    def _place(self, labs: np.ndarray) -> np.ndarray:
        """The row in ``centres`` of each label."""
        at = np.searchsorted(self.known, labs)
        return np.where(np.append(self.known, 0)[at] == labs, at, len(self.known)) if len(self.known) else np.zeros(len(labs), int)

    @staticmethod
    def _rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        return r

    def encode(self, vectors: np.ndarray, labs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a 64-bit part of each code as int64; the substrings as int64, a row for each vector, a column for each
        table; whether the vector is an inner one)."""
        x = np.zeros((len(vectors), self.dim))
        x[:, : vectors.shape[1]] = vectors
        x = x / np.linalg.norm(x, axis=1, keepdims=True) - self.centres[self._place(labs)]
        bits = x.astype(np.float32) @ self.rotation > 0
        short = np.packbits(bits[:, :64], axis=1).view(">i8").ravel().astype(np.int64)
        parts = bits[:, : self.tables * self.bits].reshape(len(x), self.tables, self.bits)
        return short, parts @ (1 << np.arange(self.bits, dtype=np.int64)), np.linalg.norm(x, axis=1) < self.inner


def _coder(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Codes = codes.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x = np.zeros((part.num_rows, c.dim))
                for i, v in enumerate(part.column("embedding").to_pylist()):
                    x[i, : len(v)] = v
                short, strings, inner = c.encode(x, part.column("lab").to_numpy())
                # An inner vector has one more string, always the same.
                strings = np.append(strings, np.zeros((len(x), 1), np.int64), axis=1)
                kept = np.append(np.ones((len(x), c.tables), bool), inner[:, None], axis=1)
                ends = np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("lab"), pa.array(short), pa.ListArray.from_arrays(ends, pa.array(strings[kept]))], names=["rep", "lab", "short", "strings"])

    return run


def scaled(v: Column) -> Column:
    """A vector times the power of two that brings its largest component near one: its squares neither overflow nor vanish,
    and cosines stay as they are. Null, NaN and infinity stay what they are."""
    finite = F.filter(F.transform(v, F.abs), lambda x: (x > 0) & (x < float("inf")))
    power = -F.floor(F.log2(F.array_max(finite)))
    # in two factors, as the whole power may be none that a double holds
    factor = lambda p: F.pow(F.lit(2.0), p.cast("double"))
    factors = F.array(F.struct(factor(F.floor(power / 2)).alias("a"), factor(power - F.floor(power / 2)).alias("b")))
    times = F.element_at(F.transform(factors, lambda f: F.transform(v, lambda x: x * f["a"] * f["b"])), 1)
    return F.when(F.size(finite) > 0, times).otherwise(v)


def cosine(a: str, b: str):
    """Cosine in double precision of two array columns of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def forest(linked: np.ndarray) -> np.ndarray:
    """The first node of each node's component, for a symmetric matrix of links."""
    root = np.arange(len(linked))
    free = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & free
            free[reached] = False
            root[reached] = start
            front = np.flatnonzero(reached)
    return root


def merged(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``component`` (the first node of each node's component) after nodes ``a`` are joined to nodes ``b``."""
    while (component[a] != component[b]).any():
        onto = np.arange(len(component))
        np.minimum.at(onto, np.maximum(component[a], component[b]), np.minimum(component[a], component[b]))
        component = onto[component]
    return component


def _block_linker(threshold: float):
    """(rep, copies linked to it, a member of its component) from rows sorted by (key, i, j): the pairs of two blocks of a
    bucket that no bucket with a smaller key has compared."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            key, i, j = (group.column(n)[0].as_py() for n in ("key", "i", "j"))
            rep, block, copies = (group.column(n).to_numpy() for n in ("rep", "block", "copies"))
            keys = group.column("keys").combine_chunks()
            x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            del group
            tiles = lambda b: [t for t in np.split(np.flatnonzero(block == b), range(TILE, len(rep), TILE)) if len(t)]  # noqa: B023, E731
            n, component = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for p, left in enumerate(tiles(i)):
                for q, right in enumerate(tiles(j)):
                    if i == j and q < p:
                        continue
                    near = x[left] @ x[right].T >= threshold
                    if i == j and p == q:
                        near &= np.arange(len(left))[:, None] < np.arange(len(left))
                    if not near.any():
                        continue
                    near = _not_met_before(near, keys, key, left, right)
                    n[left] += near @ copies[right]
                    n[right] += near.T @ copies[left]
                    component = merged(component, *_spanning(near, left, right, component))
            met = np.flatnonzero(n)
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(rep[met]), pa.array(n[met]), pa.array(rep[component[met]])], names=["rep", "n", "other"])

    return link


def _not_met_before(near: np.ndarray, keys: pa.Array, key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``near`` without the pairs that share a bucket with a smaller key."""
    before = earlier_buckets(keys.take(pa.array(np.append(left, right))), key)
    if not before.shape[1]:
        return near
    return near & (before[: len(left)] @ before[len(left) :].T == 0)


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and nodes to join them to, of the links between nodes that ``component`` does not hold together yet."""
    a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    met = np.unique(np.append(left[a], right[b]))
    if (component[met] == component[met[:1]]).all():
        return met[:0], met[:0]
    linked = np.zeros((len(met), len(met)), bool)
    linked[np.ix_(np.searchsorted(met, left[a]), np.searchsorted(met, right[b]))] = near[np.ix_(a, b)]
    return met, met[forest(linked | linked.T)]


def _in_blocks(rows: DataFrame, reps: DataFrame, keys: DataFrame, width: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Links within large buckets ``rows(key, rep)``: each bucket is dealt to blocks, each pair of blocks is one group."""
    size = max(64, BLOCK_NUMBERS // width)
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / size), F.least(F.ceil(n / FEW), F.lit(SPREAD)))
    counts = rows.groupBy("key").agg(blocks.cast("long").alias("blocks"))
    members = scratch.write(reps.join(keys, "rep").select("rep", "copies", "embedding", "keys"), "members")
    dealt = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep")
    units = units.join(members, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return scratch.write(units.mapInArrow(_block_linker(threshold), "rep long, n long, other long"), "links-of-blocks")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding array, label, ...)``: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``threshold``; candidates come from the tables, so a pair at the threshold is missed with
    probability MISS, and a closer pair less often. Vectors that are null, empty, zero, or hold null or non-finite
    components, and rows with a null vec_id or label, link with nothing: n_links 0, component_id their vec_id, kept true.
    Rows that repeat a vec_id count as vectors of their own, and ties in cosine need no order, as every link counts. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding").cast("array<double>")).alias("embedding"), "label")
    sound = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = v.withColumn("ok", ok).withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(11), "label", "embedding"))
    rows = scratch.write(rows, "vectors")
    usable = rows.where("ok").drop("ok")
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first(F.xxhash64("label", F.size("embedding"))).alias("lab"))
    # A number of its own for each class: vec_ids may repeat.
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n_classes, label_size = classes.groupBy("lab").count().agg(F.sum("count"), F.sum(F.col("count").cast("double") ** 2)).first()
    if not n_classes:
        return alone
    label_size /= n_classes
    first = usable.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    reps = scratch.write(classes.join(first, ["h1", "h2"]).select("rep", "lab", "copies", "embedding"), "representatives")

    width = reps.agg(F.max(F.size("embedding"))).first()[0]
    sample, labs = np.zeros((min(SAMPLE, n_classes), width)), np.zeros(min(SAMPLE, n_classes), np.int64)
    for i, r in enumerate(reps.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding", "lab").collect()):
        sample[i, : len(r.embedding)], labs[i] = r.embedding, r.lab
    codes = Codes(sample, labs, threshold, label_size)

    coded = reps.mapInArrow(_coder(spark.sparkContext.broadcast(codes)), "rep long, lab long, short long, strings array<long>")
    entries = coded.select("rep", "lab", "short", F.posexplode("strings").alias("t", "string"))
    entries = scratch.write(entries.select(F.xxhash64("lab", "t", "string").alias("key"), "rep", "lab", "short", (F.col("t") == codes.tables).alias("inner")), "tables")
    sizes = scratch.write(entries.groupBy("key").agg(F.count("*").alias("n"), F.first("lab").alias("lab"), F.first("inner").alias("inner")).where("n > 1"), "sizes")
    shared = scratch.write(entries.drop("lab", "inner").join(sizes, "key"), "shared")

    is_large = (F.col("n") > SMALL) | F.col("inner")
    large = shared.where(is_large)
    work = sizes.where(is_large).groupBy("lab").agg(F.sum(F.col("n").cast("double") ** 2).alias("work"))
    members = large.select("lab", "rep").distinct().groupBy("lab").agg(F.count("*").cast("double").alias("m"))
    whole = scratch.write(work.join(members, "lab").where("m * m <= work").select("lab", F.lit(True).alias("whole")), "whole-labels")
    dense = large.join(whole, "lab", "left").select(F.when(F.col("whole"), F.xxhash64("lab", F.lit("all"))).otherwise(F.col("key")).alias("key"), "rep")
    dense = scratch.write(dense.distinct(), "large-buckets")
    keys = scratch.write(dense.groupBy("rep").agg(F.collect_list("key").alias("keys")), "buckets-of")  # at most one a table
    in_blocks = _in_blocks(dense, reps, keys, width, threshold, scratch)

    small = shared.where(~is_large)
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).where("x.rep < y.rep").where(F.bit_count(F.col("x.short").bitwiseXOR(F.col("y.short"))) <= codes.radius)
    pairs = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    held = lambda k: keys.select(F.col("rep").alias(k), F.col("keys").alias(f"k{k}"))
    pairs = pairs.join(held("a"), "a", "left").join(held("b"), "b", "left").where(~F.coalesce(F.arrays_overlap("ka", "kb"), F.lit(False))).select("a", "b")
    pairs = scratch.write(pairs, "candidates")
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("embedding").alias(f"v{k}"), F.col("copies").alias(f"n{k}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").where(cosine("va", "vb") >= threshold)
    links = scratch.write(scored.select("a", "b", "na", "nb"), "links")

    counts = links.select(F.col("a").alias("rep"), F.col("nb").alias("n")).union(links.select("b", "na")).union(in_blocks.select("rep", "n"))
    counts = counts.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(links.select("a", "b").union(in_blocks.select(F.col("rep").alias("a"), F.col("other").alias("b"))), scratch)
    by_class = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_class = scratch.write(by_class.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component", "least"), "by-class")
    named = scratch.write(by_class.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    by_class = by_class.join(named, "component").select("h1", "h2", "n_links", "component_id")
    found = usable.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return found.union(alone)
