"""Masking of personal data: regular expressions and name lists to numbered placeholders, and tallies of what was masked.

Choosing spans and numbering them needs one text at a time, so it runs in an Arrow-batched function that returns the
text and its hits as structs; everything counted afterwards is a DataFrame aggregation. Lists of names are a file that
each executor fetches once and its workers map; a text in which built-in expressions find nothing that a rule could match
never reaches Python.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import names
from .names import HONORIFICS, JOIN, MIN_LETTERS, TOKEN, NameIndex, entry_key, spellings

MATCH_SECONDS = 2.0
#: The canton codes, and the patterns that always apply, in order of precedence.
_CANTONS = "AG|AI|AR|BE|BL|BS|FR|GE|GL|GR|JU|LU|NE|NW|OW|SG|SH|SO|SZ|TG|TI|UR|VD|VS|ZG|ZH"
MANDATORY = (
    ("license-plate", "LicensePlate", rf"(?<![\p{{L}}\p{{M}}\d])(?<!Kanton\s)(?<!canton\s)(?<!Kt\.\s)(?:{_CANTONS})[ \-]?[1-9]\d{{0,2}}(?:[ ']?\d{{3}})?(?![\d\p{{L}}])"),
    ("phone", "Phone", r"(?<![\d+])(?:(?:\+|00)41[ .\-]?(?:\(0\)[ .\-]?)?|0)[1-9]\d(?:[ .\-/]?\d){7}(?!\d)"),
    ("email", "Email", r"(?<![\p{L}\p{M}\d._%+\-])[\p{L}\p{M}\d._%+\-]+@[\p{L}\p{M}\d\-]+(?:\.[\p{L}\p{M}\d\-]+)*\.\p{L}{2,}(?![\p{L}\p{M}\d\-])"),
)
#: Strings no rule may touch.
PROTECTED = ("B1", "G1", "P", "B1 kollidierte mit G1", "80 km/h", "um 14.30 Uhr", "um 07.45 Uhr", "A1", "N1", "Hauptstrasse 12", "Km 12.5", "Rega 1414", "Notruf 117", "Notruf 144", "im Kanton ZH 2 Verletzte")
IMPORT_SECONDS, TRIAL_LENGTH = 0.25, 4096
#: What a value is compared without, shapes of ids and tags.
_NOISE = regex.compile(r"[\s\-./()]")
_RULE_ID, _RULE_TAG = r"[a-z0-9][a-z0-9-]{0,63}", r"[A-Z][A-Za-z]{1,31}"
#: What a text must hold for a mandatory rule to match at all; cheaper to look for.
_NEEDED = {"license-plate": re.compile(rf"(?:{_CANTONS})[ \-]?[1-9]"), "phone": re.compile(r"\d\d"), "email": re.compile("@")}
#: The same for built-in expressions, which look behind at digits only.
_SUSPECT = rf"@|[0-9](?:[0-9]|(?<=(?:{_CANTONS})[ \-]?[1-9]))"
#: Of each value of a rule: contexts shown, characters around it, and the values listed of a rule, the first met.
CONTEXTS, AROUND, MAX_VALUES = 3, 40, 2000
#: Fixed value: hits from which on an entry of a list is named among the most hit.
MOST_HIT = 10
HITS = "array<struct<rule_id:string,tag:string,start:int,end:int,number:int,value:string,entry:string,out_start:int>>"
RESULT = f"text string, hits {HITS}, timed_out string"
_HIT = pa.struct([(n, pa.int32() if n in ("start", "end", "number", "out_start") else pa.string()) for n in ("rule_id", "tag", "start", "end", "number", "value", "entry", "out_start")])
_RESULT = pa.struct([("text", pa.string()), ("hits", pa.list_(_HIT)), ("timed_out", pa.string())])
#: Bytes of text, and rows, that a worker holds as Python objects at once; a longer text is held on its own.
PART_BYTES, PART_ROWS = 1 << 20, 1000


class SlowRule(TimeoutError):
    """A rule that took too long over a text."""

    def __init__(self, rule_id: str):
        super().__init__(rule_id)
        self.rule_id = rule_id


def search_entries(entries: list[str], query: str) -> list[str]:
    """Entries that contain the query in one of its spellings; a query without letters finds all."""
    forms = lambda s: [" ".join(p) for p in zip(*map(spellings, TOKEN.findall(s)), strict=True)]
    wanted = forms(query)
    return [e for e in entries if not wanted or any(w in h for w in wanted for h in forms(e))]


@dataclass(frozen=True)
class Rules:
    """What masks: extra patterns (rule id, tag, pattern) after the mandatory ones, and lists of names."""

    patterns: tuple[tuple[str, str, str], ...] = ()
    firstnames: tuple[str, ...] = ()
    lastnames: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    seconds: float = MATCH_SECONDS

    @property
    def all_patterns(self) -> tuple[tuple[str, str, str], ...]:
        return MANDATORY + self.patterns

    def index(self) -> NameIndex:
        return NameIndex.build(self.firstnames, self.lastnames, self.whitelist)

    def fingerprint(self) -> str:
        """sha256 of everything that decides an outcome; the order of a list decides nothing."""
        lists = {k: sorted(set(map(entry_key, getattr(self, k)))) for k in ("firstnames", "lastnames", "whitelist")}
        return hashlib.sha256(json.dumps({"patterns": self.all_patterns, "honorifics": HONORIFICS, "min_letters": MIN_LETTERS, **lists}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Scrubber:
    def __init__(self, rules: Rules, index: NameIndex | None = None):
        self.rules = rules
        self.compiled = [(rule_id, tag, regex.compile(p)) for rule_id, tag, p in rules.all_patterns]
        self.names = index or rules.index()

    def spans(self, text: str) -> list[tuple[int, int, str, str, str, str | None]]:
        """(start, end, tag, rule, value, list entry) of what is masked, left to right."""
        found = []
        for order, (rule_id, tag, pattern) in enumerate(self.compiled):
            if order < len(MANDATORY) and not _NEEDED[rule_id].search(text):
                continue
            try:
                for m in pattern.finditer(text, timeout=self.rules.seconds):
                    if m.end() > m.start():
                        found.append((m.start(), -m.end(), order, tag, rule_id, _NOISE.sub("", m[0]).casefold()))
            except TimeoutError:
                raise SlowRule(rule_id) from None
        taken, reach = [], 0
        for start, minus_end, _, tag, rule_id, value in sorted(found):
            if start >= reach:
                reach = -minus_end
                taken.append((start, reach, tag, rule_id, value, None))
        starts = [t[0] for t in taken]
        free = lambda a, b: (k := bisect.bisect_left(starts, b)) == 0 or taken[k - 1][1] <= a
        return sorted(taken + [n for n in self._named(text) if free(n[0], n[1])])

    def _named(self, text: str) -> list[tuple[int, int, str, str, str, str | None]]:
        if not self.names.longest:
            return []
        matches, spans = self.names.matches(text)
        last = [m.at + m.width for m in matches]
        glued = [e == m.at and bool(JOIN.fullmatch(text, spans[e - 1][1], spans[e][0])) for e, m in zip(last, matches[1:])]  # noqa: B905
        tags = names.tagged(matches, glued)
        return [(spans[m.at][0], spans[e - 1][1], tag, f"names-{tag.lower()}", key, key) for m, e, (tag, key) in zip(matches, last, tags, strict=True)]

    def scrub(self, text: str) -> tuple[str, list[dict]]:
        """The text with placeholders, numbered per tag by first occurrence of a value, and the hits. Raises SlowRule
        where a pattern takes too long."""
        numbers: dict[str, dict[str, int]] = {}
        parts, hits, at, length = [], [], 0, 0
        for start, end, tag, rule_id, value, entry in self.spans(text):
            of_tag = numbers.setdefault(tag, {})
            number = of_tag.setdefault(value, len(of_tag) + 1)
            mark = f"<{tag}_{number}>"
            parts += [text[at:start], mark]
            hits.append({"rule_id": rule_id, "tag": tag, "start": start, "end": end, "number": number, "value": value, "entry": entry, "out_start": length + start - at})
            length += start - at + len(mark)
            at = end
        return "".join([*parts, text[at:]]), hits


@functools.lru_cache(maxsize=2)
def _scrubber(rules: Rules, lists: str) -> Scrubber:
    return Scrubber(rules, NameIndex.open(SparkFiles.get(lists)))


def may_match(text: Column, rules: Rules, index: NameIndex) -> Column:
    """Whether any rule may match in a text, by built-in expressions: where this is false, none does."""
    if rules.patterns:
        return F.lit(True)
    needed = text.rlike(_SUSPECT)
    listed = names.may_hold_names(text, index) if index.longest else F.lit(False)
    return F.lit(True) if listed is None else needed | listed


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about PART_BYTES of text and at most PART_ROWS rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and (held + size > PART_BYTES or k - at >= PART_ROWS):
            yield texts[at:k]
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield texts[at:]


def scrubbed(spark: SparkSession, text: Column | str, rules: Rules = Rules()) -> Column:
    """struct<text, hits, timed_out> of a text column; a null text stays null. Where a rule takes too long text is null
    and timed_out names the rule. The column is computed once for each row, however often its fields are used."""
    text = F.col(text) if isinstance(text, str) else text
    index = rules.index()
    lists = names.publish(spark, index, rules.fingerprint())
    patterns = replace(rules, firstnames=(), lastnames=(), whitelist=())

    def one(work: Scrubber, text: str | None) -> dict:
        if text is None:
            return {}
        try:
            masked, hits = work.scrub(text)
            return {"text": masked, "hits": hits}
        except SlowRule as e:
            return {"hits": [], "timed_out": e.rule_id}

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = _scrubber(patterns, lists)
        for batch in batches:
            for texts in parts(batch):
                yield pa.array([one(work, t) for t in texts.to_pylist()], _RESULT)


    # Texts that no rule can touch are null on their way to Python and themselves afterwards.
    suspect = F.when(may_match(text, rules, index), text)
    found = run.asNondeterministic()(suspect)
    untouched = F.named_struct(F.lit("text"), text, F.lit("hits"), F.array().cast(HITS), F.lit("timed_out"), F.lit(None).cast("string"))
    return F.element_at(F.transform(F.array(found), lambda f: F.when(f["hits"].isNull() & text.isNotNull(), untouched).otherwise(f)), 1)


def rule_table(rules: Rules) -> list[tuple[str, str, str]]:
    """(rule id, tag, source) of every rule that runs, in order; those of names where their lists hold an entry."""
    held = lambda entries: any(sum(len(spellings(t)[0]) for t in TOKEN.findall(e)) >= MIN_LETTERS for e in entries)
    first, last = held(rules.firstnames), held(rules.lastnames)
    of_lists = [(f"names-{tag.lower()}", tag, "list") for tag, runs in (("Firstname", first), ("Lastname", last), ("Name", first and last)) if runs]
    return [(r, tag, "mandatory") for r, tag, _ in MANDATORY] + [(r, tag, "imported") for r, tag, _ in rules.patterns] + of_lists


def _every_rule(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rule_table(rules))], "place int, rule_id string, tag string, source string")


def _by_rule(hits: DataFrame, rules: Rules) -> DataFrame:
    """Per rule that runs (those without hits too), from (k, rule_id): rule_id, place, tag, source, hits, records."""
    each = hits.groupBy("rule_id").agg(F.count("*").alias("hits"), F.countDistinct("k").alias("records"))
    return _every_rule(hits.sparkSession, rules).join(each, "rule_id", "left").fillna(0, ["hits", "records"])


def scrub_tally(results: DataFrame, rules: Rules, key: str) -> DataFrame:
    """Per rule that runs (those without hits too): hits and distinct records, from (key, hits)."""
    hits = results.select(F.col(key).alias("k"), F.explode("hits").alias("h")).select("k", "h.rule_id")
    return _by_rule(hits, rules).select("rule_id", "hits", "records")


def scrub_findings(tally: DataFrame) -> DataFrame:
    """TEXT_SCRUBBED for every rule that ran, rules without hits included; matched text stays out."""
    text = lambda c: F.col(c).cast("string")
    return tally.select(F.lit("TEXT_SCRUBBED").alias("code"), F.create_map(F.lit("rule_id"), F.col("rule_id"), F.lit("hits"), text("hits"), F.lit("records"), text("records")).alias("detail"))


def scrub_timeouts(results: DataFrame, key: str) -> DataFrame:
    """TEXT_SCRUB_TIMEOUT, which blocks a freeze, for every text over which a rule took too long: code, key, detail."""
    slow = results.where(F.col("timed_out").isNotNull())
    return slow.select(F.lit("TEXT_SCRUB_TIMEOUT").alias("code"), F.col(key).cast("string").alias("key"), F.create_map(F.lit("rule_id"), F.col("timed_out")).alias("detail"))


def entry_tally(results: DataFrame, least: int = MOST_HIT) -> DataFrame:
    """List entries with at least so many hits, most first."""
    each = results.select(F.explode("hits").alias("h")).where("h.entry IS NOT NULL").groupBy(F.col("h.entry").alias("entry")).agg(F.count("*").alias("hits"))
    return each.where(F.col("hits") >= least).orderBy(F.desc("hits"), "entry")


def _in_context(results: DataFrame, key: str, original: str, around: int, hits: Column, *others: str) -> DataFrame:
    """Per hit: k, rule_id, v (what hits that share a placeholder share), entry, start, placeholder, before, matched, after."""
    line = lambda c: F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))
    h = results.select(F.col(key).alias("k"), F.col(original).alias("o"), F.col("text").alias("t"), *others, hits.alias("h")).select("k", "o", "t", *others, "h.*")
    placeholder = F.concat(F.lit("<"), F.col("tag"), F.lit("_"), F.col("number").cast("string"), F.lit(">"))
    end = F.col("out_start") + F.length(placeholder)
    return h.select(
        "rule_id", "k", F.coalesce("entry", "value").alias("v"), "entry", "start", *others, placeholder.alias("placeholder"),
        line(F.substr("t", F.greatest(F.col("out_start") - around, F.lit(0)) + 1, F.least(F.lit(around), F.col("out_start")))).alias("before"),
        line(F.substr("o", F.col("start") + 1, F.col("end") - F.col("start"))).alias("matched"), line(F.substr("t", end + 1, F.lit(around))).alias("after"),
    )


def _by_value(rows: DataFrame, contexts: int, values: int) -> DataFrame:
    """Per rule and value, from hits in context: rule_id, v, value, hits, records, other_hits, examples."""
    met = ("k", "start", "matched", "placeholder", "before", "after")
    first = F.min(F.struct(*met)).alias("first")
    each = rows.groupBy("rule_id", "v").agg(F.count("*").alias("hits"), F.countDistinct("k").alias("records"), first)
    listed = each.withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy("first"))).where(F.col("n") <= values)
    total = each.groupBy("rule_id").agg(F.sum("hits").alias("all_hits"), F.min("first").alias("of_all"))
    named = listed.groupBy("rule_id").agg(F.sum("hits").alias("listed_hits")).join(total, "rule_id").select("rule_id", (F.col("all_hits") - F.col("listed_hits")).alias("other_hits"), "of_all")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("rule_id", "v").orderBy(*met))).where(F.col("n") <= contexts)
    example = F.struct("n", F.col("k").cast("string").alias("record_key"), "placeholder", "before", "matched", "after")
    shown = ranked.groupBy("rule_id", "v").agg(F.transform(F.sort_array(F.collect_list(example)), lambda x: x.dropFields("n")).alias("examples"))
    out = listed.join(named, "rule_id").where("first >= of_all").join(shown, ["rule_id", "v"])
    return out.select("rule_id", "v", F.col("first.matched").alias("value"), "hits", "records", "other_hits", "examples")


def scrub_examples(results: DataFrame, key: str, original: str = "original", contexts: int = CONTEXTS, around: int = AROUND, values: int = MAX_VALUES) -> DataFrame:
    """Per rule and value, from (key, original, text, hits): value, hits, records, other_hits and the first examples,
    structs of record_key, placeholder, before, matched, after.

    Hits that share a placeholder share a value: list entries, or matches without separators and case; it is shown as it
    was first met. Only the first values of a rule are listed, and other_hits counts its hits on the others. Texts are met
    in order of key, hits in order of place.
    """
    # Counts and examples read one shuffle, for which both ask for the same columns, so that texts are masked once
    # (no value is met before the first of its rule).
    rows = _in_context(results, key, original, around, F.explode("hits")).where("rule_id IS NOT NULL AND v IS NOT NULL").repartition("rule_id", "v", "k")
    return _by_value(rows, contexts, values).drop("v")


def scrub_preview(
    results: DataFrame, rules: Rules, key: str, original: str = "original", least: int = MOST_HIT, contexts: int = CONTEXTS, around: int = AROUND, values: int = MAX_VALUES,
) -> DataFrame:
    """The dry run of a freeze, from (key, original, text, hits, timed_out), where a key may have several texts: what the
    rules would count and replace. Nothing is written.

    Rows by part, in this order: ``records`` (one: records with a text that was masked, those changed, the rule that took too
    long over the first of such texts in order of key, the fingerprint of the rules), ``rule`` (tag, source, hits and records of
    each that ran, in their order), ``entry`` (those of a list with at least so many hits, most first), ``value`` (as in
    ``scrub_examples``, most hits first). A text over which a rule takes too long is counted nowhere else; the others all are.
    """
    texts = results.where(F.col(original) != "")
    rows = _in_context(texts, key, original, around, F.explode_outer("hits"), "timed_out")
    # A text without hits is a row of a rule without a name. All parts read one shuffle, by all columns, so that none asks for
    # fewer, and drop nothing below it, so that texts are masked once.
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_id", "v")})
    rows = rows.repartition(*rows.columns)

    per = rows.groupBy("k").agg(F.bool_or(F.col("timed_out").isNull()).alias("seen"), F.bool_or(F.col("rule_id") != "").alias("hit"), F.min("timed_out").alias("slow"))
    count = lambda c: F.count(F.when(F.col(c), F.col("k")))
    slow = F.min(F.when(F.col("slow").isNotNull(), F.struct("k", "slow")))["slow"]
    total = per.agg(count("seen").alias("records"), count("hit").alias("changed"), slow.alias("timed_out")).withColumn("fingerprint", F.lit(rules.fingerprint()))
    by_rule = _by_rule(rows, rules)
    by_entry = rows.groupBy(F.col("entry").alias("value")).agg(F.count("entry").alias("hits")).where(F.col("hits") >= max(least, 1))
    by_value = _by_value(rows, contexts, values).join(_every_rule(results.sparkSession, rules).select("place", "rule_id"), "rule_id")
    parts = [df.withColumns({"part": F.lit(name), "at": F.lit(at)}) for at, (name, df) in enumerate((("records", total), ("rule", by_rule), ("entry", by_entry), ("value", by_value)))]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("at", "place", F.desc("hits"), "value", "v")
    return out.select("part", "rule_id", "tag", "source", "value", "hits", "records", "changed", "other_hits", "timed_out", "fingerprint", "examples")


def check_rules(rules: list[dict], protected: list[str], seconds: float = IMPORT_SECONDS) -> list[tuple[str, str]]:
    """(rule id, problem) of imported rules: shape, compilation, time, empty matches, examples, protected strings."""
    out = []
    for r in rules:
        rule_id = r.get("id", "")
        if not regex.fullmatch(_RULE_ID, rule_id):
            out.append((rule_id, "id"))
        if not regex.fullmatch(_RULE_TAG, r.get("tag", "")):
            out.append((rule_id, "tag"))
        try:
            p = regex.compile(r.get("pattern", ""))
        except regex.error:
            out.append((rule_id, "does not compile"))
            continue
        try:
            if p.search("", timeout=seconds):
                out.append((rule_id, "matches nothing at all"))
            for text in (unit * (TRIAL_LENGTH // len(unit)) for unit in ("a", "1 ", "aA1-")):
                p.search(text + "!", timeout=seconds)
            out += [(rule_id, f"must match: {x}") for x in r.get("must_match", ()) if not p.search(x, timeout=seconds)]
            out += [(rule_id, f"must not match: {x}") for x in r.get("must_not_match", ()) if p.search(x, timeout=seconds)]
            out += [(rule_id, f"touches protected: {x}") for x in (*PROTECTED, *protected) if p.search(x, timeout=seconds)]
        except TimeoutError:
            out.append((rule_id, "too slow"))
    return out
