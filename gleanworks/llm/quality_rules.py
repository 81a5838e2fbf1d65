"""Operator 4: quality rules, a threshold table compiled into one projection of built-in expressions.

No shuffle, no join, no user function: each document is judged from its own text, so the work is in proportion to the
text whatever its source, and a very long text is one row of one task.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 5
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he in is it not of on or she that the they this to was were which with you "
    "auf das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les mais ne pas par pour que qui se sur un une "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

#: (rule, feature, comparison, threshold): a document is kept when every rule holds. ``mean_word`` is code points in
#: words per word; the others are shares of words, word characters or lines.
RULES: list[tuple[str, str, str, float]] = [
    ("words not too short", "mean_word", ">=", 2.0),
    ("words not too long", "mean_word", "<=", 15.0),
    ("few symbols", "symbol_ratio", "<=", 0.1),
    ("few exclamations", "bang_ratio", "<=", 0.2),
    ("not in capitals", "upper_ratio", "<=", 0.4),
    ("some function words", "stop_ratio", ">=", 0.05),
    ("few repeated lines", "dup_line_ratio", "<=", 0.3),
]
COMPARE = {">=": operator.ge, "<=": operator.le}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window which occurs twice or more, each word counted once."""

    def covered(windows: Column) -> Column:
        def spans(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")))["n"]

        def found(ranked: Column) -> Column:
            # ``get`` gives null outside the array, so the first and last have one neighbour.
            same = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
            twice = F.transform(ranked, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return spans(F.array_sort(F.filter(twice, lambda i: i.isNotNull())))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), found))

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return let(F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))), covered)

    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_m`` of the counts and ratios; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    plain = words_of(F.lower(F.translate(t, PUNCTUATION, "")))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    base = docs.withColumns({"_w": words_of(t), "_l": lines})
    counts = {
        "n_words": F.size("_w").cast("long"),
        "word_chars": (F.length(t) - count_of(t, SPACES)).cast("long"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_w")),
        "_n_lines": F.size("_l").cast("long"),
        "_bangs": count_of(t, "!"),
        "_upper": count_of(t, UPPER),
        "_stops": F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))).cast("long"),
    }
    base = base.withColumn("_m", F.struct(*(c.alias(n) for n, c in counts.items()))).drop("_w", "_l")
    m = F.col("_m")
    ratios = {
        "mean_word": share(m["word_chars"], m["n_words"]),
        "symbol_ratio": share(m["n_symbols"], m["n_words"]),
        "bang_ratio": share(m["_bangs"], m["n_words"]),
        "upper_ratio": share(m["_upper"], m["word_chars"]),
        "stop_ratio": share(m["_stops"], m["n_words"]),
        "dup_line_ratio": share(m["n_dup_lines"], m["_n_lines"]),
    }
    return base.withColumn("_m", F.struct(*(m[n].alias(n) for n in counts), *(c.alias(n) for n, c in ratios.items())))


def verdict(m: Column, rules: list[tuple[str, str, str, float]] | None = None) -> tuple[Column, Column]:
    """(base_failed, kept) from the struct of ``measure``."""
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    passed = functools.reduce(operator.and_, (COMPARE[op](m[feature], F.lit(limit)) for _, feature, op, limit in rules or RULES), F.lit(True))
    return base_failed, ~base_failed & passed


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the ratios of the threshold table.

    Words are runs of anything but ASCII white space. A null or empty text has no words, fails the base rule and is not
    kept. Any doc_id, null or repeated, is passed on; other columns are ignored; an empty table gives an empty result.
    """
    found = measure(docs.select("doc_id", "text"))
    m = F.col("_m")
    base_failed, kept = verdict(m)
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ratios = ("mean_word", "symbol_ratio", "bang_ratio", "upper_ratio", "stop_ratio", "dup_line_ratio")
    return found.select("doc_id", *(m[n].alias(n) for n in named), base_failed.alias("base_failed"), kept.alias("kept"), *(m[n].alias(n) for n in ratios))


def oracle_sql() -> str:
    """DuckDB SQL for the same rows, written from the same table of rules."""
    strip = "translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    passed = " AND ".join(f"{feature} {op} {limit}" for _, feature, op, limit in RULES)
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT r, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
    keyed AS (SELECT r, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k FROM win),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM twice) GROUP BY r),
    c AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length({strip})::BIGINT AS word_chars,
          (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
          (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
          len(ls) AS n_lines, length(text) - length(translate(text, '!', '')) AS bangs,
          length(text) - length(translate(text, '{UPPER}', '')) AS uppers,
          len(list_filter(regexp_extract_all(lower(translate(text, '{PUNCTUATION}', '')), '[^\x20\x09-\x0D]+'), lambda x: x IN ({stops}))) AS stops
          FROM w LEFT JOIN rep ON w.r = rep.r),
    f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
          {share("word_chars", "n_words")} AS mean_word, {share("n_symbols", "n_words")} AS symbol_ratio, {share("bangs", "n_words")} AS bang_ratio,
          {share("uppers", "word_chars")} AS upper_ratio, {share("stops", "n_words")} AS stop_ratio, {share("n_dup_lines", "n_lines")} AS dup_line_ratio FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept,
           mean_word, symbol_ratio, bang_ratio, upper_ratio, stop_ratio, dup_line_ratio FROM f
    """
