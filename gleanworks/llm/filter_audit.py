"""Operator 12: how the filters of a corpus interact, for every order in which they can be applied.

Four filters look at a text alone; the fifth drops a text that a smaller doc_id has, anywhere in the table. Equal texts are
found by sorting: rows are dealt to ranges of (text fingerprint, doc_id) and sorted by fingerprint, full text and doc_id, so
a group of copies of any size is spread over tasks and each row is compared with its predecessor only. The first text of a
range may go on from the range before; those few rows are settled among themselves afterwards. What is left of a document is
a mask of five bits, and the masks of a part are counted: every number of the report is a sum over at most 32 counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """The bits of filters A to D that ``text`` fails."""
    words = F.array_remove(F.split(text, SPACE), "")

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < MIN_WORDS, BIT["A"]).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * n, BIT["B"]).otherwise(0)

    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    c = F.when(100 * upper > MAX_UPPER_PERCENT * F.length(text), BIT["C"]).otherwise(0)
    d = F.when(text.rlike(SYMBOLS), BIT["D"]).otherwise(0)
    return (F.element_at(F.transform(F.array(words), of), 1) + c + d).cast("int")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, text, doc_id): whether one is a later copy in this range, and the text of those still open.

    The rows of the range's first text that have its smallest doc_id here are open: a range before may hold a smaller one.
    So are the rows of its last fingerprint with the smallest doc_id of their text, which the next range may go on with.
    """
    first_fp = text = smallest = None
    held: pa.RecordBatch | None = None  # rows of the last fingerprint that are not later copies
    for batch in batches:
        if not batch.num_rows:
            continue
        fps, ids, texts = batch.column("fp").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("text")
        if first_fp is None:
            first_fp = int(fps[0])
        new = [True]
        if text is not None:
            new = [pc.not_equal(texts[0], text).as_py()]
        new += pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()
        later = []
        for is_new, i in zip(new, ids.tolist(), strict=True):
            if is_new:
                smallest = i
            later.append(i > smallest)
        text = texts[len(texts) - 1]
        later = pa.array(later, pa.bool_())
        edge = pc.and_(pc.invert(later), pc.equal(batch.column("fp"), first_fp))
        at_end = pc.and_(pc.invert(later), pc.equal(batch.column("fp"), int(fps[-1])))
        if held is not None:  # it was the last fingerprint of the batch before
            goes_on = held.column("fp")[0].as_py() == int(fps[-1])
            if not goes_on:
                yield _settled(held, first_fp, False)
                held = None
        tail = batch.filter(at_end)
        done = _marked(batch, later, edge, pc.invert(at_end))
        if done.num_rows:
            yield done
        if tail.num_rows:
            held = tail if held is None else pa.Table.from_batches([held, tail]).combine_chunks().to_batches()[0]
    if held is not None:
        yield _settled(held, first_fp, True)


def _marked(batch: pa.RecordBatch, later: pa.Array, edge: pa.Array, which: pa.Array) -> pa.RecordBatch:
    texts = pc.if_else(edge, batch.column("text"), pa.scalar(None, batch.column("text").type))
    columns = [batch.column("doc_id"), batch.column("part"), batch.column("mask"), batch.column("fp"), later, edge, texts]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "fp", "copy", "open", "text"]).filter(which)


def _settled(held: pa.RecordBatch, first_fp: int, at_end: bool) -> pa.RecordBatch:
    n = held.num_rows
    edge = at_end or held.column("fp")[0].as_py() == first_fp
    every = pa.array([True] * n, pa.bool_())
    return _marked(held, pa.array([False] * n, pa.bool_()), pa.array([edge] * n, pa.bool_()), every)


def failure_masks(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, part, mask) for each row of ``docs(doc_id, text, lang, ...)``: the bits of the filters A to E that it fails.

    A null text is empty, a null lang the part ''. Equal texts are equal code point by code point; a row fails E if its text
    stands at any smaller doc_id, so rows that repeat a doc_id do not fail for each other's sake, and a null doc_id is
    neither smaller nor larger than any. Texts travel once and whole, however long.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = text_mask(F.col("text")).alias("mask")
    named = rows.where("doc_id IS NOT NULL").withColumn("fp", F.xxhash64("text"))
    ordered = named.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = ordered.select("doc_id", "part", "fp", mask, "text").mapInArrow(_compared, "doc_id long, part string, mask int, fp long, copy boolean, open boolean, text string")
    found = scratch.write(found, "compared")
    open_rows = found.where("open").select("doc_id", "part", "mask", "fp", "text")
    smallest = open_rows.groupBy("fp", "text").agg(F.min("doc_id").alias("smallest"))
    settled = open_rows.join(smallest, ["fp", "text"]).select("doc_id", "part", "mask", (F.col("doc_id") > F.col("smallest")).alias("copy"))
    both = found.where("NOT open").select("doc_id", "part", "mask", "copy").unionByName(settled)
    both = both.select("doc_id", "part", (F.col("mask") + F.when(F.col("copy"), BIT["E"]).otherwise(0)).alias("mask"))
    return both.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", mask))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order (120) and step (1-5): kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley, all long, zeros included.

    ``labels(doc_id, quality, toxic)`` may repeat a doc_id: a document is good (toxic) if any of its rows has quality (toxic)
    1; nulls count as neither. Other columns, also of clashing names, are ignored; an empty table gives no rows, and a part
    exists when a row has its lang.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))))
    documents = failure_masks(docs).join(marks, "doc_id", "left")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    counters = documents.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("bad"))
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("counters"))  # at most 32
    return report(parts)


def report(parts: DataFrame) -> DataFrame:
    """The 600 rows of each part from its counters (mask, n, good, bad)."""
    steps = []
    for order in permutations(FILTERS):
        for k, name in enumerate(order):
            steps.append(f"{''.join(order)},{k + 1},{BIT[name]},{sum(BIT[x] for x in order[:k])}")
    listed = F.transform(F.split(F.lit(";".join(steps)), ";"), lambda s: F.split(s, ","))
    each = parts.select("part", "counters", F.explode(listed).alias("s"))
    each = each.select("part", "counters", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("bit"), F.col("s")[3].cast("int").alias("before"))

    def total(where, value="n", times=None) -> Column:
        def add(acc: Column, c: Column) -> Column:
            v = c[value] * times(c) if times else c[value]
            return acc + F.when(where(c["mask"]), v).otherwise(F.lit(0).cast("long"))

        return F.aggregate("counters", F.lit(0).cast("long"), add)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) > 0
    passed = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & passed(m)
    # Of the 120 orders each of a mask's filters comes first in 120 / (number of filters failed).
    share = lambda c: F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(c["mask"]))
    shapley = F.aggregate(F.filter("counters", lambda c: fails(c["mask"])), F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * share(c))
    return each.select(
        "part", "filter_order", "step",
        total(lambda m: passed(m) & ~fails(m)).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "bad").alias("toxic_lost"), shapley.alias("shapley"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the same rows."""
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
          CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
          + CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 3 * length(t) THEN 4 ELSE 0 END
          + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
          FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::BIGINT AS before FROM o, range(1, 6) r(k))
    SELECT part, filter_order, step,
           coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
           coalesce(sum(n * (120 // greatest(bit_count(mask::BIGINT), 1))) FILTER (mask & bit > 0), 0)::BIGINT AS shapley
    FROM c, s GROUP BY part, filter_order, step
    """
