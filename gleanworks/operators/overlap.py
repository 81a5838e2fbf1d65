"""Exact overlaps of many sets at once: keys that lie in the same sets on both sides count as one weighted row.

Files that share keys, columns that share codes: pairs are needed only for those that meet, yet a key that lies in n sets of
either side meets n times n of them. Keys are therefore collapsed by their signature, the sets that they lie in, before any
pair is made; how many signatures there are depends on the sets and not on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lefts, rights, n) from ``left(name, k)`` and ``right(name, k)``: how many keys lie in just these sets of both sides.

    Null keys and names are left out, repeated rows count once. A key's signature is as long as the number of sets it lies in.
    """
    named = lambda df, out: df.where("k IS NOT NULL AND name IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_set("name")).alias(out))
    both = named(left, "lefts").join(named(right, "rights"), "k")
    return both.groupBy("lefts", "rights").agg(F.count("*").alias("n"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, overlap) of the sets that share keys."""
    each = signatures(left, right).select(F.explode("lefts").alias("l"), "rights", "n")
    # rows of a set are added up by the other side's signature before that is spread out
    each = each.groupBy("l", "rights").agg(F.sum("n").alias("n")).select("l", F.explode("rights").alias("r"), "n")
    return each.groupBy("l", "r").agg(F.sum("n").alias("overlap"))
