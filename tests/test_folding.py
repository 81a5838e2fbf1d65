"""Folding by built-in expressions and by Python: the same for every text."""

import random

from pyspark.sql import functions as F

from gleanworks.functions import text

PIECES = ["a", "B", "ß", "ẞ", "Straße", "ÄÖÜ", "é", "É", "ÿ", "Ÿ", "ñ", "ø", "æ", "ﬁ", "ſ", "İ", "ı", "Σς", "½", "²", "…", "ﾊﾞ", "日本", "ü", "́", "«x»", "–", "'", "’", ".", ",", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "(", ")", "-", "€", "K", "Å", "Ω"]


def texts():
    rng = random.Random(6)
    return ["", None, ".", " . ", "...", "\x1c", *PIECES] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]


def test_normalised_text(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "k int, t string")
    got = {r.k: r.n for r in rows.select("k", text.normalise_text(F.col("t")).alias("n")).collect()}
    assert [got[k] for k in range(len(got))] == [text.fold_text(t) for t in texts()]


def test_folded_search(spark):
    found = texts()
    queries = [*PIECES, "", None, "STRASSE", "aou"]
    rows = [(k, t, queries[k % len(queries)]) for k, t in enumerate(found * 2)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, t string, q string").select("k", text.text_contains("t", "q").alias("c")).collect()}
    assert [got[k] for k, _, _ in rows] == [None if t is None or q is None else text.fold_search(q) in text.fold_search(t) for _, t, q in rows]
