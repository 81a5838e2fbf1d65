"""Operator 1: near-duplicate documents by HyperMinHash.

A document's set holds its distinct 5-word shingles. One hash of each shingle picks a bucket and a 53-bit rest; a
bucket's register keeps the smallest rest as its leading-zero count (6 bits) and the 10 mantissa bits below it.
Registers are banded; documents that agree on a band are candidates, the register agreement (corrected for accidental
collisions) estimates Jaccard, and what passes is confirmed on the full sets.

At scale: exact copies collapse to one class before any band is made, so a group of copies of any size adds one row.
The band rows (50 a class, 20 bytes each) are counted with map-side combine and only shared bands go on. No group is
expanded to pairs. First each class is confirmed against the smallest class of the bands that it shares most, then
against one of the largest component in its bands, which joins most copies of a text to one component. After that only
bands in which different components meet are looked at: the few members of small ones as pairs, the members of large
ones in blocks inside tasks. These compare sketches first; the texts of members that may be linked follow to their block,
are confirmed on full sets there, and only links that join two components come back. Members of a band's largest component
meet its other members, not each other. In a band with more than a block of other members an exact filter takes the
band's place: two sets that are linked share one of their rarest shingles, of which each set needs a quarter at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, earlier_buckets, groups, mix64, shingle_sets

BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Pairs whose estimate is this far below the threshold are not confirmed: seven standard errors at 250 registers. Sets
#: of fewer than TINY shingles, whose registers hold few different values, are confirmed whatever the estimate.
SLACK, TINY = 0.2, 64
#: Bands of at most so many members are compared as pairs; larger ones in blocks. A member takes 1 + shingles / SHINGLES of
#: the BLOCK places of a block, so that long texts share it with fewer others.
SMALL, BLOCK, SHINGLES = 8, 1024, 2000


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, a row for each set; a set without shingles has zeros."""
    n = len(sets)
    least = np.full(n * REGISTERS, np.uint64(2**64 - 1))
    sizes = np.array([len(s) for s in sets])
    if sizes.sum() == 0:
        return np.zeros((n, REGISTERS), np.uint16)
    h = np.concatenate(sets)
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    np.minimum.at(least, np.repeat(np.arange(n), sizes) * REGISTERS + bucket.astype(np.int64), mix64(h ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11))
    least = least.reshape(n, REGISTERS)
    filled = least != np.uint64(2**64 - 1)
    mantissa, exponent = np.frexp(np.where(filled, least, 0).astype(np.float64))
    zeros = np.where(least == 0, 53, 53 - exponent)
    regs = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | np.where(least == 0, 0, np.floor((mantissa * 2 - 1) * 2**MANTISSA)).clip(0, 2**MANTISSA - 1).astype(np.uint16)
    # An empty bucket borrows from one that its own fixed random sequence names first, so that agreement stays Jaccard.
    rows, cols = np.nonzero(~filled & (sizes > 0)[:, None])
    given, attempt = regs.copy(), 0
    while len(rows):
        attempt += 1
        salt = np.uint64(attempt * 0xC2B2AE3D27D4EB4F % 2**64)
        source = (mix64(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(REGISTERS)).astype(np.int64)
        found = filled[rows, source]
        given[rows[found], cols[found]] = regs[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    given[sizes == 0] = 0
    return given


def accidental(mantissa: int = MANTISSA) -> float:
    """The chance that the registers of two different minima agree: both in one binade (1/3), then equal mantissas."""
    return 1 / 3 * 2.0**-mantissa


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard from rows of registers, corrected for accidental collisions."""
    agree, by_chance = (a == b).mean(axis=1), accidental()
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64 keys, BANDS for each row of registers."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()])
            regs = registers(sets)
            size = np.array([len(s) for s in sets], np.int64)
            one = np.array([mix64(s + np.uint64(0x51)).sum(dtype=np.uint64) for s in sets], np.uint64)
            two = np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "text_id", "n_shingles", "h1", "h2", "regs"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            rep, size = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("rep", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel()), pa.array(rep), pa.array(size)], names=["key", "rep", "size"])


def worth_confirming(regs_a: np.ndarray, regs_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these registers and sizes may be linked."""
    small, big = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * small >= percent * big) & ((big < TINY) | (estimate(regs_a, regs_b) >= percent / 100 - SLACK))


def _estimator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                part = batch.slice(lo, 5000)
                regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
                sizes = [part.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b")]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(worth_confirming(*regs, *sizes, percent))], names=["a", "b", "worth"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                both = [(t or "").encode() for c in ("text_a", "text_b") for t in part.column(c).to_pylist()]
                sets, n = shingle_sets(both), part.num_rows
                linked = [_linked(sets[i], sets[n + i], percent) for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return confirm


class _Confirm:
    """Confirms pairs of classes on full texts, which are written once for all rounds."""

    def __init__(self, members: DataFrame, percent: int, scratch: Scratch):
        self.members, self.percent, self.scratch = members, percent, scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        side = lambda k, *columns: self.members.select(F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns))
        pairs = self.scratch.write(pairs, "pairs")
        near = pairs.join(side("a", "regs", "size"), "a").join(side("b", "regs", "size"), "b").select("a", "b", "regs_a", "regs_b", "size_a", "size_b")
        rough = self.scratch.write(near.mapInArrow(_estimator(self.percent), "a long, b long, worth boolean"), "estimates")
        full = rough.where("worth").join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
        done = full.mapInArrow(_confirmer(self.percent), "a long, b long, linked boolean")
        return self.scratch.write(done.union(rough.where("NOT worth").select("a", "b", F.lit(False).alias("linked"))), "confirmed")


def _open_bands(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``rows(key, rep, size, comp)`` those of bands in which different components meet, with n (members), major (the
    largest component) and the places of a block that its members (most) and the others (rest) take."""
    place = 1 + F.col("size") / SHINGLES
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(place).alias("places"))
    bands = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.max(F.struct("n", "comp", "places")).alias("m")).where("m.n < n")
    bands = scratch.write(bands.select("key", "n", F.col("m.comp").alias("major"), F.col("m.places").alias("most"), (F.col("places") - F.col("m.places")).alias("rest")), "mixed")
    return scratch.write(rows.join(bands, "key"), "open-bands")


def _best(rows: DataFrame) -> DataFrame:
    """Of ``rows(rep, hub)``, a row for each band that they share, each rep with the hub that it shares most bands with."""
    best = rows.where("rep <> hub").groupBy("rep", "hub").count().groupBy("rep").agg(F.max(F.struct("count", -F.col("hub"))).alias("m"))
    return best.select(F.least("rep", -F.col("m.col2")).alias("a"), F.greatest("rep", -F.col("m.col2")).alias("b")).distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = shingle_sets([t.encode() for t in part.column("text").to_pylist()])
            n = [len(x) for x in sets]
            rep, size, comp = (pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("rep", "size", "comp"))
            yield pa.RecordBatch.from_arrays([rep, size, comp, pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["rep", "size", "comp", "shingle"])


def _rarest(rows: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``rows(key, rep, size, comp)`` for the members of ``rows``, with keys that linked ones share surely: of a set of n
    shingles the n - ceil(percent * n / 100) + 1 rarest among these members. Shingles that no other member has take places
    and make no key."""
    held = rows.select("rep", "size", "comp").distinct()
    each = scratch.write(members.select("rep", "text").join(held, "rep").mapInArrow(_shingles, "rep long, size long, comp long, shingle long"), "shingles")
    shared = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    met = each.join(shared, "shingle")
    # the set's own shingles come first, and fill as many places
    order = Window.partitionBy("rep").orderBy("n", "shingle")
    ranked = met.withColumn("place", F.row_number().over(order) + F.col("size") - F.count("*").over(Window.partitionBy("rep")))
    places = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return ranked.where(F.col("place") <= places).select(F.xxhash64("shingle", F.lit("rare")).alias("key"), "rep", "size", "comp")


def _block_linker(percent: int, on_texts: bool):
    """From rows sorted by (key, i, j), the pairs of two blocks of a band that no band with a smaller key has compared: links
    (a, b) that join components; without texts the members (key, i, j, rep) that may have some."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            key, i, j = (group.column(n)[0].as_py() for n in ("key", "i", "j"))
            rep, size, block, comp = (group.column(n).to_numpy() for n in ("rep", "size", "block", "comp"))
            regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            before = earlier_buckets(group.column("keys").combine_chunks(), key)
            sets, links, may = {}, [], np.zeros(len(rep), bool)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for x in left:
                rest = right[right > x] if i == j else right
                rest = rest[comp[rest] != comp[x]]
                rest = rest[before[rest] @ before[x] == 0]
                rest = rest[worth_confirming(regs[x : x + 1], regs[rest], size[x], size[rest], percent)]
                if not len(rest):
                    continue
                may[x] = may[rest] = True
                if not on_texts:
                    continue
                texts, new = group.column("text"), [k for k in (x, *rest) if k not in sets]
                sets.update(zip(new, shingle_sets([texts[int(k)].as_py().encode() for k in new]), strict=True))
                for y in rest:
                    if comp[x] != comp[y] and _linked(sets[x], sets[y], percent):
                        links.append((rep[x], rep[y]))
                        comp = np.where(comp == comp[y], comp[x], comp)
            if on_texts and links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
            if not on_texts and may.any():
                at = [pa.array(np.full(may.sum(), v)) for v in (key, i, j)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(rep[may])], names=["key", "i", "j", "rep"])

    return link


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, i, j, block, comp, rep) from rows as of ``_open_bands``: a row for each pair of blocks (i, j) that a member is
    in. Members outside the band's largest component are in the first blocks; two blocks of that component make no pair."""
    alone = F.col("most") + F.col("rest") <= BLOCK
    outer = F.when(alone, 1).otherwise(F.ceil(F.col("rest") / BLOCK)).cast("long")
    inner = F.when(alone, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("long")
    is_outer = (F.col("comp") != F.col("major")) | (F.col("inner") == 0)
    deal = F.xxhash64("rep")
    dealt = rows.withColumns({"outer": outer, "inner": inner})
    dealt = dealt.withColumn("block", F.when(is_outer, F.pmod(deal, F.col("outer"))).otherwise(F.col("outer") + F.pmod(deal, F.greatest("inner", F.lit(1)))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_outer, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "rep")


def _linked_in_blocks(rows: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components within large bands, from rows as of ``_open_bands``. Each pair of blocks is one
    group, so that no group grows with the band; sketches go to all of a member's groups, its text to those where it may be
    linked."""
    keys = rows.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    sketched = scratch.write(members.drop("text").join(keys, "rep"), "sketched")
    dealt = scratch.write(_dealt(rows), "dealt")

    def grouped(units: DataFrame) -> DataFrame:
        return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    may = grouped(dealt.join(sketched, "rep")).mapInArrow(_block_linker(percent, False), "key long, i long, j long, rep long")
    may = dealt.join(scratch.write(may, "may-be-linked"), ["key", "i", "j", "rep"])
    texts = members.select("rep", "text")
    return grouped(may.join(sketched, "rep").join(texts, "rep")).mapInArrow(_block_linker(percent, True), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs(doc_id long, text string, ...)``: doc_id, n_shingles, component_id, kept, text_id, stays.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of 5-word shingles (A-Z lower-cased,
    words split at ASCII white space). component_id is the smallest doc_id reachable; kept marks that document. Whole texts
    count, however long. A null or wordless text has n_shingles 0 and is alone. A null doc_id gets component_id null and
    kept true, and takes no part in linking. Rows that repeat a doc_id each get a row, linked by their own text and not by
    the id; text_id, a hash of the text, tells them apart, and stays marks one text of each group: the first by doc_id,
    then text_id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_id", F.xxhash64("text"))
    sketches = scratch.write(docs.mapInArrow(_sketch, "doc_id long, text_id long, n_shingles long, h1 long, h2 long, regs binary"), "sketches")

    linkable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = linkable.groupBy("h1", "h2", "doc_id", "text_id").agg(F.count("*").alias("times"))
    classes = copies.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_id", "times")).alias("m")).select("h1", "h2", "m.*")
    # A number of its own for each class: doc_ids may repeat.
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    repeated = not classes.where("times > 1").isEmpty()
    once = lambda df: df.dropDuplicates(["rep"]) if repeated else df
    regs = once(linkable.join(classes.drop("times"), ["h1", "h2", "doc_id", "text_id"]).select("rep", "regs", F.col("n_shingles").alias("size")))
    regs = scratch.write(regs, "registers")

    bands = regs.mapInArrow(_bands, "key long, rep long, size long")
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1").drop("n")
    hits = scratch.write(bands.join(shared, "key"), "shared-bands")
    involved = classes.join(hits.select("rep").distinct(), "rep").select("rep", "doc_id", "text_id")
    texts = once(docs.join(involved, ["doc_id", "text_id"]).select("rep", "text"))
    members = scratch.write(regs.join(texts, "rep"), "members")
    confirm = _Confirm(members, percent, scratch)

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        comps = scratch.write(connected_components(links.where("linked").select("a", "b"), scratch), "components")
        named = rows.join(comps, rows.rep == comps.node, "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
        return _open_bands(scratch.write(named, "labelled"), scratch)

    done = confirm(_best(hits.select("rep", "hub")))
    rows = labelled(hits, done)
    hubs = rows.where("comp = major").groupBy("key").agg(F.min("rep").alias("hub"))
    again = _best(rows.where("comp <> major").join(hubs, "key").select("rep", "hub"))
    done = done.union(confirm(again.join(done, ["a", "b"], "left_anti")))
    rows = labelled(rows, done)

    huge = (F.col("n") > SMALL) & (F.col("rest") > BLOCK)
    if not rows.where(huge).isEmpty():
        rarest = scratch.write(_rarest(rows.where(huge), members, percent, scratch), "rarest")
        rows = rows.where(~huge).unionByName(_open_bands(rarest, scratch))
    small = rows.where(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).where("x.comp < y.comp")
    met = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    done = done.union(confirm(met.join(done, ["a", "b"], "left_anti")))
    blocked = scratch.write(rows.where(F.col("n") > SMALL), "large-bands")
    in_blocks = scratch.write(_linked_in_blocks(blocked, members, percent, scratch), "links-of-blocks")
    links = done.where("linked").select("a", "b").union(in_blocks)

    comps = connected_components(links, scratch)
    by_class = classes.join(comps, classes.rep == comps.node, "left").withColumn("comp", F.coalesce("component", "rep"))
    by_class = scratch.write(by_class.select("h1", "h2", "doc_id", "text_id", "comp"), "by-class")
    named = scratch.write(by_class.groupBy("comp").agg(F.min(F.struct("doc_id", "text_id")).alias("first")), "components")
    by_class = by_class.join(named, "comp").select("h1", "h2", "first")
    lone = sketches.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_id", F.lit(True).alias("stays"))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    found = linkable.join(by_class, ["h1", "h2"]).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "text_id", stays.alias("stays"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.union(lone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_id", "stays")
