"""Emptiness, normalisation and matching of source values, as column expressions.

Source values are strings; an empty string means that no value was given. Normalising never fails: what does not parse
stays as its trimmed text, so that it can still be compared and counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("enum", "integer", "decimal", "date", "time", "boolean", "free_text")
#: Spellings of truth and falsehood.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "ja", "oui", "si", "wahr", "vrai")
FALSE_WORDS = ("0", "false", "f", "no", "n", "nein", "non", "falsch", "faux")
#: Characters that group the digits of a number, and punctuation dropped at the edges of free text.
GROUPING = " '\u00a0\u2019_"
EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»\u201c\u201d\u2018\u2019-\u2013\u2014/\\"


def strip(value: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_empty(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def normalise_enum(value: Column) -> Column:
    return strip(value)


def normalise_integer(value: Column) -> Column:
    """Plain digits of any length, without grouping, plus sign and leading zeros; other text trimmed."""
    bare = F.translate(strip(value), GROUPING, "")
    number = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), F.when(number == "-0", "0").otherwise(number)).otherwise(strip(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Significant digits that a number keeps where no precision is given; exponents of more digits stay text.
SIGNIFICANT, EXPONENT_DIGITS = 28, 4
_NUMBER = rf"^([+-]?)(?=\.?[0-9])([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{{1,{EXPONENT_DIGITS}}}))?$"


def normalise_decimal(value: Column, precision: int | None = 2) -> Column:
    """Rounded half-even at ``precision`` (None: at 28 significant digits), written plainly without trailing zeros; other
    text trimmed. Exact for any number of digits: the digits are rounded as text."""
    text = F.translate(strip(value), "," + GROUPING, ".")
    part = lambda k: F.regexp_extract(text, _NUMBER, k)
    exponent = F.coalesce(part(4).try_cast("int"), F.lit(0))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))

    def rounded(x: Column) -> Column:
        """(digits, scale) of struct(d, scale) after the digits to drop are gone."""
        n = F.length(x["d"])
        drop = F.greatest(x["scale"] - precision if precision is not None else n - SIGNIFICANT, F.lit(0))
        keep = F.substr(x["d"], F.lit(1), F.greatest(n - drop, F.lit(0)))
        rest = F.when(drop > n, F.lit("0")).otherwise(F.substr(x["d"], F.greatest(n - drop, F.lit(0)) + 1))
        return let(F.struct(F.when(keep == "", "0").otherwise(keep).alias("k"), rest.alias("r"), (x["scale"] - drop).alias("scale")), carried)

    def carried(x: Column) -> Column:
        first, odd = F.substr(x["r"], F.lit(1), F.lit(1)), F.right(x["k"], F.lit(1)).isin(*"13579")
        up = (first > "5") | (first == "5") & (F.substr(x["r"], F.lit(2)).rlike("[1-9]") | odd)
        nines = F.length(F.regexp_extract(x["k"], "9*$", 0))
        head = F.concat(F.lit("0"), F.substr(x["k"], F.lit(1), F.length(x["k"]) - nines))
        more = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.translate(F.right(head, F.lit(1)), "012345678", "123456789"), zeros(nines))
        return let(F.struct(F.when(up, more).otherwise(x["k"]).alias("k"), x["scale"].alias("scale")), plain)

    def plain(x: Column) -> Column:
        digits = F.concat(zeros(x["scale"] + 1 - F.length(x["k"])), x["k"], zeros(-x["scale"]))
        whole = F.regexp_replace(F.substr(digits, F.lit(1), F.length(digits) - F.greatest(x["scale"], F.lit(0))), "^0+(?=.)", "")
        fraction = F.regexp_replace(F.right(digits, F.greatest(x["scale"], F.lit(0))), "0+$", "")
        return F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))

    number = F.struct(F.regexp_replace(F.concat(part(2), part(3)), "^0+(?=.)", "").alias("d"), (F.length(part(3)) - exponent).alias("scale"))
    sign = F.when(part(1) == "-", "-").otherwise("")
    return F.when(text.rlike(_NUMBER), F.concat(sign, let(number, rounded))).otherwise(strip(value))


def normalise_date(value: Column) -> Column:
    """yyyy-mm-dd of eight digits that are a day of the calendar; other text trimmed."""
    digits = F.translate(strip(value), "-", "")
    day = F.try_to_date(F.when(digits.rlike(r"^[0-9]{8}$"), digits), "yyyyMMdd")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), strip(value))


def normalise_time(value: Column) -> Column:
    """Minutes since midnight of H:MM, H:MM:SS or HHMM; other text trimmed."""
    text = strip(value)
    pattern = r"^([0-9]+):([0-9]+)(?::[^:]*)?$"
    packed = text.rlike(r"^[0-9]{4}$")
    hour = F.when(packed, F.substring(text, 1, 2)).otherwise(F.regexp_extract(text, pattern, 1)).try_cast("int")
    minute = F.when(packed, F.substring(text, 3, 2)).otherwise(F.regexp_extract(text, pattern, 2)).try_cast("int")
    return F.when(hour.between(0, 23) & minute.between(0, 59), (hour * 60 + minute).cast("string")).otherwise(text)


def normalise_boolean(value: Column) -> Column:
    text = F.lower(strip(value))
    return F.when(text.isin(*TRUE_WORDS), "true").when(text.isin(*FALSE_WORDS), "false").otherwise(strip(value))


def fold_text(text: str | None) -> str | None:
    """Compatibility form, case folded, white space collapsed, edge punctuation dropped unless nothing would be left."""
    if text is None:
        return None
    folded = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    return folded.strip(EDGES) or folded


def fold_search(text: str) -> str:
    """For substring search: lower case, ß as ss, marks dropped."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


#: Letters beyond ASCII of which built-in expressions know the folded form, and signs that folding leaves alone.
_LETTERS, _BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
_KNOWN = "^[\\x00-\\x7FÀ-ÅÇ-ÏÑ-ÖÙ-Ýß-åç-ïñ-öù-ýÿ«»–—“”„‘’€]*\\z"


def _bare(text: Column) -> Column:
    """The folded form for search of a text that _KNOWN matches."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _LETTERS, _BARE)


@F.pandas_udf(T.StringType())
def _fold_texts(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(fold_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_searches(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(fold_search, na_action="ignore")


def normalise_text(value: Column | str) -> Column:
    """``fold_text`` of a column: of ASCII by built-in expressions; other rows alone go to Python."""
    value = F.col(value) if isinstance(value, str) else value
    edges = "[" + "".join(f"\\x{ord(c):02x}" for c in EDGES if ord(c) < 128) + "]+"
    line = F.trim(F.regexp_replace(F.lower(value), r"[\s\x0b\x1c-\x1f]+", " "))
    bare = F.regexp_replace(line, f"^{edges}|{edges}\\z", "")
    plain = value.rlike(r"^[\x00-\x7F]*\z")
    return F.when(plain, F.when(bare == "", line).otherwise(bare)).otherwise(_fold_texts(F.when(~plain, value)))


def text_contains(text: Column | str, query: Column | str) -> Column:
    """Whether the folded query is inside the folded text; an empty query is inside everything. Rows whose letters built-in
    expressions know stay out of Python."""
    sides = [F.col(x) if isinstance(x, str) else x for x in (text, query)]
    folded = [F.when(x.rlike(_KNOWN), _bare(x)).otherwise(_fold_searches(F.when(~x.rlike(_KNOWN), x))) for x in sides]
    return F.contains(*folded)


def normalise(value: Column, value_type: Column, precision: int = 2, free_text: bool = True) -> Column:
    """Normalised by the type in each row. ``free_text=False`` keeps the plan free of Python for tables without it."""
    kinds = {"integer": normalise_integer(value), "decimal": normalise_decimal(value, precision), "date": normalise_date(value), "time": normalise_time(value), "boolean": normalise_boolean(value)}
    if free_text:
        kinds["free_text"] = normalise_text(value)
    out = normalise_enum(value)
    for kind, column in kinds.items():
        out = F.when(value_type == kind, column).otherwise(out)
    return out


def matches(truth: Column, answer: Column, value_type: Column, tolerance_minutes: Column | None = None, **options) -> Column:
    """Equality after normalising; times may differ by a tolerance. An empty value matches nothing."""
    a, b = normalise(truth, value_type, **options), normalise(answer, value_type, **options)
    same = a == b
    if tolerance_minutes is not None:
        apart = F.abs(a.try_cast("int") - b.try_cast("int"))
        same = same | ((value_type == "time") & F.coalesce(apart <= tolerance_minutes, F.lit(False)))
    return ~is_empty(truth) & ~is_empty(answer) & F.coalesce(same, F.lit(False))


def classify(truth: Column, answer: Column, matched: Column) -> Column:
    """hit, wrong or missing; null where the truth is empty, and such a case counts nowhere."""
    return F.when(is_empty(truth), None).when(is_empty(answer), "missing").when(matched, "hit").otherwise("wrong")
