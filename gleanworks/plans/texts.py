"""Queries on narratives: masking, prompts, answers."""

from __future__ import annotations

import functools
import re

import pandas as pd
import regex
from pyspark.sql import functions as F

from ..catalog import query, read, spread
from ..functions import text
from ..operators import extraction, runs, scrub
from ..operators.scrub import Rules

RULES = Rules(firstnames=("Erin", "Martin", "Onan"), lastnames=("Anan", "Erin", "Müller"), whitelist=("Onan",))


def _scrubbed(spark, sf, rules=Rules()):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", F.col("text").alias("original"), scrub.scrubbed(spark, "text", rules).alias("s")).select("doc_id", "original", "s.text", "s.hits", "s.timed_out")


def _hits_of(rule_id: str):
    return F.size(F.filter("hits", lambda h: h["rule_id"] == rule_id)).cast("long")


@query("scrub")
def scrub_(spark, sf):
    return _scrubbed(spark, sf, RULES).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("hits").alias("n_hits"))


@query("scrub_mandatory")
def scrub_mandatory(spark, sf):
    return _scrubbed(spark, sf).select("doc_id", *(_hits_of(r).alias(r.replace("-", "_")) for r, _, _ in scrub.MANDATORY))


_EMAIL = r"[\p{L}\p{M}\d._%+\-]+@[\p{L}\p{M}\d\-]+(\.[\p{L}\p{M}\d\-]+)*\.\p{L}{2,}"


@query("scrub_email_count", f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS n FROM documents")
def scrub_email_count(spark, sf):
    return _scrubbed(spark, sf).select("doc_id", _hits_of("email").alias("n"))


@query("scrub_tally")
def scrub_tally(spark, sf):
    return scrub.scrub_tally(_scrubbed(spark, sf, RULES), RULES, "doc_id")


def _shown():
    shown = F.transform("examples", lambda e: F.concat_ws(" ", e["record_key"], e["placeholder"], e["before"], e["after"]))
    return F.array_join(shown, " / ").alias("examples")


@query("scrub_preview")
def scrub_preview(spark, sf):
    """Counts of records, rules and most hit entries, and the examples of each value, from texts that are masked once."""
    found = scrub.scrub_preview(_scrubbed(spark, sf, RULES), RULES, "doc_id")
    return found.select(*found.drop("examples").columns, _shown())


@query("scrub_examples")
def scrub_examples(spark, sf):
    found = scrub.scrub_examples(_scrubbed(spark, sf), "doc_id")
    return found.select("rule_id", "value", "hits", "records", "other_hits", _shown())


# Texts whose hits follow from the key: a phone number in two spellings, a plate, an address, names.
_PHONE = "CASE WHEN c_custkey % 3 = 0 THEN '079-123-45-6' ELSE '079 123 45 6' END || (c_custkey % 10)"
_PLANTED = f"'Am Tag ' || c_custkey || ' rief ' || {_PHONE} || ' an.' || CASE WHEN c_custkey % 4 = 0 THEN ' Wagen SG 12' || (300 + c_custkey % 7) || ' da.' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' Mail an k' || (c_custkey % 3) || '@post.example.ch bitte.' ELSE '' END || CASE WHEN c_custkey % 6 = 0 THEN ' Anna Meier kam.' WHEN c_custkey % 6 = 1 THEN ' Herr Müller kam.' ELSE '' END"
_PLANTED_RULES = Rules(firstnames=("Anna",), lastnames=("Meier", "Müller"))


def _planted(spark, sf):
    text = F.expr(_PLANTED.replace("c_custkey", "CAST(c_custkey AS STRING)").replace("CAST(c_custkey AS STRING) %", "c_custkey %"))
    c = spread(read(spark, sf, "customer").select("c_custkey")).select("c_custkey", text.alias("original"))
    return c.withColumn("s", scrub.scrubbed(spark, "original", _PLANTED_RULES)).select("c_custkey", "original", "s.text", "s.hits", "s.timed_out")


#: Syllables of made names: 50 000 last names and 20 000 first names, a number for each.
_SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()
_N = len(_SYLLABLES)


def made_name(k: int, end: str) -> str:
    a, b, c = k % _N, k // _N % _N, k // _N**2
    return (_SYLLABLES[a] + _SYLLABLES[b] + _SYLLABLES[c] + end).capitalize()


@functools.cache
def long_lists() -> Rules:
    """Lists of the length that real ones have."""
    return Rules(firstnames=tuple(made_name(k, "nia") for k in range(20_000)), lastnames=tuple(made_name(k, "rsen") for k in range(50_000)))


def _name_sql(k: str, end: str) -> str:
    syllable = lambda n: f"split('{' '.join(_SYLLABLES)}', ' ')[CAST({n} AS INT) + 1]"
    made = "||".join(syllable(n) for n in (f"(({k}) % {_N})", f"(floor(({k}) / {_N}) % {_N})", f"floor(({k}) / {_N**2})"))
    return f"upper(substr({made}, 1, 1)) || substr({made}, 2) || '{end}'"


_KNOWN = _name_sql("o_orderkey * 7 % 20000", "nia"), _name_sql("o_orderkey * 11 % 50000", "rsen")
_UNKNOWN = _name_sql("o_orderkey % 50000", "xel")


@query("scrub_long_lists", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Frau <Firstname_1> <Lastname_1> sah ' || {_UNKNOWN} || ' und <Lastname_1>.' ELSE {_UNKNOWN} || ' sah nichts.' END AS masked, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END AS n_hits FROM orders""")
def scrub_long_lists(spark, sf):
    """Lists of 70 000 names over a text for each order, two thirds of them without a listed name."""
    named = f"CASE WHEN o_orderkey % 3 = 0 THEN 'Frau ' || {_KNOWN[0]} || ' ' || {_KNOWN[1]} || ' sah ' || {_UNKNOWN} || ' und ' || upper({_KNOWN[1]}) || '.' ELSE {_UNKNOWN} || ' sah nichts.' END"
    spelt = F.expr(re.sub(r"\[(CAST\(.*? AS INT\)) \+ 1\]", r"[\1]", named))
    found = spread(read(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", scrub.scrubbed(spark, spelt, long_lists()).alias("s"))
    return found.select("o_orderkey", F.col("s.text").alias("masked"), F.size("s.hits").alias("n_hits"))


_RULE_HITS = {"license-plate": "c_custkey % 4 = 0", "phone": "true", "email": "c_custkey % 5 = 0", "names-firstname": "c_custkey % 6 = 0", "names-lastname": "c_custkey % 6 <= 1", "names-name": "false"}


@query("scrub_tally_planted", " UNION ALL ".join(f"SELECT '{r}' AS rule_id, count(*) FILTER (WHERE {w})::BIGINT AS hits, count(*) FILTER (WHERE {w})::BIGINT AS records FROM customer" for r, w in _RULE_HITS.items()))
def scrub_tally_planted(spark, sf):
    return scrub.scrub_tally(_planted(spark, sf), _PLANTED_RULES, "c_custkey")


@query("scrub_examples_planted", f"""WITH t AS (SELECT c_custkey AS k, c_custkey % 10 AS d, {_PHONE} AS m FROM customer), g AS (SELECT d, arg_min(m, k) AS value, count(*)::BIGINT AS hits, min(k) AS k FROM t GROUP BY d)
 SELECT value, hits, hits AS records, (sum(hits) OVER () - sum(CASE WHEN rn <= 4 THEN hits ELSE 0 END) OVER ())::BIGINT AS other_hits, least(hits, 3)::BIGINT AS n_examples, 'Am Tag ' || k || ' rief' AS before, rn FROM (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM g) QUALIFY rn <= 4""".replace(", rn FROM (SELECT", " FROM (SELECT"))
def scrub_examples_planted(spark, sf):
    found = scrub.scrub_examples(_planted(spark, sf), "c_custkey", values=4).where("rule_id = 'phone'")
    return found.select("value", "hits", "records", "other_hits", F.size("examples").cast("long").alias("n_examples"), F.col("examples")[0]["before"].alias("before"))


#: The hits of the planted texts: key, rule, what they share, what is written.
_PLANTED_HITS = f"""SELECT c_custkey AS k, 'phone' AS rule_id, CAST(c_custkey % 10 AS VARCHAR) AS v, {_PHONE} AS m FROM customer
 UNION ALL SELECT c_custkey, 'license-plate', CAST(c_custkey % 7 AS VARCHAR), 'SG 12' || (300 + c_custkey % 7) FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT c_custkey, 'email', CAST(c_custkey % 3 AS VARCHAR), 'k' || (c_custkey % 3) || '@post.example.ch' FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT c_custkey, 'names-firstname', 'anna', 'Anna' FROM customer WHERE c_custkey % 6 = 0
 UNION ALL SELECT c_custkey, 'names-lastname', 'meier', 'Meier' FROM customer WHERE c_custkey % 6 = 0
 UNION ALL SELECT c_custkey, 'names-lastname', 'mueller', 'Müller' FROM customer WHERE c_custkey % 6 = 1"""
_PLANTED_TABLE = "('license-plate', 'LicensePlate', 'mandatory'), ('phone', 'Phone', 'mandatory'), ('email', 'Email', 'mandatory'), ('names-firstname', 'Firstname', 'list'), ('names-lastname', 'Lastname', 'list'), ('names-name', 'Name', 'list')"


@query("scrub_preview_planted", f"""WITH h AS ({_PLANTED_HITS})
 SELECT 'records' AS part, NULL AS rule_id, NULL AS tag, NULL AS source, NULL AS value, NULL::BIGINT AS hits, count(*)::BIGINT AS records, (SELECT count(DISTINCT k) FROM h)::BIGINT AS changed, NULL::BIGINT AS other_hits, NULL::BIGINT AS n_examples, NULL AS first_key FROM customer
 UNION ALL SELECT 'rule', r.rule_id, tag, source, NULL, count(k)::BIGINT, count(DISTINCT k)::BIGINT, NULL, NULL, NULL, NULL FROM (VALUES {_PLANTED_TABLE}) r(rule_id, tag, source) LEFT JOIN h USING (rule_id) GROUP BY ALL
 UNION ALL SELECT 'entry', NULL, NULL, NULL, v, count(*)::BIGINT, NULL, NULL, NULL, NULL, NULL FROM h WHERE starts_with(rule_id, 'names-') GROUP BY v HAVING count(*) >= 10
 UNION ALL SELECT 'value', rule_id, NULL, NULL, arg_min(m, k), count(*)::BIGINT, count(DISTINCT k)::BIGINT, NULL, 0, least(count(*), 3)::BIGINT, CAST(min(k) AS VARCHAR) FROM h GROUP BY rule_id, v""")
def scrub_preview_planted(spark, sf):
    found = scrub.scrub_preview(_planted(spark, sf), _PLANTED_RULES, "c_custkey")
    n = F.size("examples").cast("long").alias("n_examples")
    return found.select("part", "rule_id", "tag", "source", "value", "hits", "records", "changed", "other_hits", n, F.col("examples")[0]["record_key"].alias("first_key"))


@query("name_tag", """SELECT c_custkey, tag, rule_id FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 6 = 0 THEN ['Firstname', 'Lastname'] WHEN c_custkey % 6 = 1 THEN ['Lastname'] ELSE [] END) AS tag FROM customer), (VALUES ('Firstname', 'names-firstname'), ('Lastname', 'names-lastname')) r(t, rule_id) WHERE t = tag""")
def name_tag(spark, sf):
    hits = _planted(spark, sf).select("c_custkey", F.explode("hits").alias("h")).where("h.entry IS NOT NULL")
    return hits.select("c_custkey", F.col("h.tag").alias("tag"), F.col("h.rule_id").alias("rule_id"))


@query("scrub_planted", f"""SELECT c_custkey, md5('Am Tag ' || c_custkey || ' rief <Phone_1> an.' || CASE WHEN c_custkey % 4 = 0 THEN ' Wagen <LicensePlate_1> da.' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' Mail an <Email_1> bitte.' ELSE '' END || CASE WHEN c_custkey % 6 = 0 THEN ' <Firstname_1> <Lastname_1> kam.' WHEN c_custkey % 6 = 1 THEN ' Herr <Lastname_1> kam.' ELSE '' END) AS masked FROM customer""")
def scrub_planted(spark, sf):
    return _planted(spark, sf).select("c_custkey", F.md5("text").alias("masked"))


@query("scrub_timeout", "SELECT 'TEXT_SCRUB_TIMEOUT' AS code, CAST(n_nationkey AS VARCHAR) AS key, 'slow' AS rule FROM nation WHERE n_nationkey % 6 = 0")
def scrub_timeout(spark, sf):
    """A rule that backtracks without end on some texts: they are findings, the others are masked."""
    rules = Rules(patterns=(("slow", "Slow", r"(?:a|aa)+$"),), seconds=0.2)
    rows = read(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.repeat(F.lit("a"), F.lit(60)), F.lit("!"))).otherwise(F.col("n_name")).alias("t"))
    found = rows.withColumn("s", scrub.scrubbed(spark, "t", rules)).select("n_nationkey", "s.*")
    return scrub.scrub_timeouts(found, "n_nationkey").select("code", "key", F.col("detail")["rule_id"].alias("rule"))


@query("entry_search", "SELECT n_nationkey, contains(lower(n_name), 'an') AS marked, contains(lower(n_name), 'an') AS written_out, contains(lower(n_name), 'an') AS plain, false AS other FROM nation")
def entry_search(spark, sf):
    """Entries with umlauts are found by the umlaut, by its written-out form and by the bare letter."""
    @F.pandas_udf("marked boolean, written_out boolean, plain boolean, other boolean")
    def found(entries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[bool(scrub.search_entries([e], q)) for q in ("ÄN", "aen", "An", "aän")] for e in entries], columns=["marked", "written_out", "plain", "other"])

    return read(spark, sf, "nation").select("n_nationkey", found(F.translate("n_name", "A", "Ä")).alias("f")).select("n_nationkey", "f.*")


@query("scrub_fingerprint", "SELECT n_nationkey, true AS same, true AS other FROM nation")
def scrub_fingerprint(spark, sf):
    """The order of a list decides nothing, an entry more does."""
    @F.pandas_udf("same boolean, other boolean")
    def compared(names: pd.Series) -> pd.DataFrame:
        of = lambda *entries: Rules(lastnames=entries).fingerprint()
        return pd.DataFrame({"same": names.map(lambda n: of(n, "Xy") == of("Xy", n)), "other": names.map(lambda n: of(n) != of(n, "Xy"))})

    return read(spark, sf, "nation").select("n_nationkey", compared("n_name").alias("c")).select("n_nationkey", "c.*")


@query("scrub_check_rules", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'must not match: ' || r_name ELSE 'does not compile' END AS problem FROM region")
def scrub_check_rules(spark, sf):
    def work(batches):
        for b in batches:
            rules = [{"id": "r", "tag": "Tag", "pattern": regex.escape(n) if k % 2 == 0 else "(" + n, "must_not_match": [n]} for k, n in zip(b.r_regionkey, b.r_name, strict=True)]
            yield pd.DataFrame({"r_regionkey": b.r_regionkey, "problem": ["; ".join(p for _, p in scrub.check_rules([r], [])) for r in rules]})

    return read(spark, sf, "region").select("r_regionkey", "r_name").mapInPandas(work, "r_regionkey int, problem string")


@query("scrub_try", "SELECT n_nationkey, 'Tel. <Phone_1>, <Phone_1> ' || n_name AS shown FROM nation")
def scrub_try(spark, sf):
    text = F.concat(F.lit("Tel. 079 123 45 67, 079-123-45-67 "), "n_name")
    return read(spark, sf, "nation").select("n_nationkey", scrub.scrubbed(spark, text).alias("s")).select("n_nationkey", F.col("s.text").alias("shown"))


@query("name_match")
def name_match(spark, sf):
    return scrub.entry_tally(_scrubbed(spark, sf, RULES), 1)


@query("text_fold_match", "SELECT doc_id, contains(t, 'ion') AS accented, contains(t, 'gross') AS sharp FROM (SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS t FROM documents)")
def text_fold_match(spark, sf):
    """Accents and sharp s are folded in the texts and in what is looked for."""
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", text.text_contains("text", F.lit("IÓN")).alias("accented"), text.text_contains("text", F.lit("Groß")).alias("sharp"))


@query("estimate_tokens", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return read(spark, sf, "documents").select("doc_id", runs.estimate_tokens(F.col("text")).alias("tokens"))


@query("longest_prompt", "SELECT doc_id, length(text)::BIGINT AS n_chars, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1")
def longest_prompt(spark, sf):
    return runs.longest_prompt(read(spark, sf, "documents"), "doc_id", "text").withColumn("n_chars", F.col("n_chars").cast("long"))


@query("resolve_template", "SELECT doc_id, md5(concat('Read: ', text, ' {{text}}', chr(10), 'in ', lang)) AS prompt_md5 FROM documents")
def resolve_template(spark, sf):
    slots = {"narrative": F.concat("text", F.lit(" {{text}}")), "language": F.col("lang")}
    return read(spark, sf, "documents").select("doc_id", F.md5(runs.resolve_template("Read: {{narrative}}\nin {{ language }}", slots)).alias("prompt_md5"))


_FEATURES = [("k", "integer"), ("flag", "boolean")]


def _answers(spark, sf):
    """Event properties wrapped as answers; some are cut off, some are no object, some lack evidence."""
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"features": {"k": {"present": true, "value": '), k, F.when(F.col("event_id") % 3 == 0, "").otherwise(', "evidence": "seen"'), F.lit('}, "flag": {"present": false, "value": null}}}'))
    raw = F.when(F.col("event_id") % 20 == 0, F.substring(whole, 1, 30)).when(F.col("event_id") % 20 == 1, "[1]").when(F.col("event_id") % 20 == 2, '{"features": []}').otherwise(whole)
    return e.select("event_id", "event_type", raw.alias("raw"))


_KEPT = "event_id % 20 > 2"
_K = "CAST(json_extract_string(props, '$.k') AS VARCHAR)"


@query("parse_output", f"SELECT event_id, 'k' AS feature_key, {_K} AS value_raw, true AS present, CASE WHEN event_id % 3 <> 0 THEN 'seen' END AS evidence FROM events WHERE {_KEPT} UNION ALL SELECT event_id, 'flag', NULL, false, NULL FROM events WHERE {_KEPT}")
def parse_output(spark, sf):
    return extraction.extraction_values(_answers(spark, sf), "event_id", "raw", _FEATURES).select("event_id", "feature_key", "value_raw", "present", "evidence")


@query("parse_issues", f"SELECT code, count(*)::BIGINT AS n FROM (SELECT CASE event_id % 20 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'features_not_object' ELSE CASE WHEN event_id % 3 = 0 THEN 'missing_evidence' END END AS code FROM events) WHERE code IS NOT NULL GROUP BY 1")
def parse_issues(spark, sf):
    p = _answers(spark, sf).select(extraction.parsed("raw", _FEATURES).alias("p"))
    codes = F.concat(F.array_compact(F.array("p.failure")), F.transform("p.issues", lambda i: i["code"]))
    return p.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("answer_fingerprint", f"SELECT event_id, sha256(concat('{{\"k\":', {_K}, '}}')) AS fingerprint FROM events")
def answer_fingerprint(spark, sf):
    return read(spark, sf, "events").select("event_id", extraction.answer_fingerprint("props").alias("fingerprint"))


@query("canonical_answer", f"SELECT event_id, concat('{{\"a\":', {_K}, ',\"b\":[true]}}') AS canonical FROM events")
def canonical_answer(spark, sf):
    @F.pandas_udf("string")
    def canonical(answers: pd.Series) -> pd.Series:
        return answers.map(extraction.canonical_answer)

    raw = F.concat(F.lit('{ "b" : [true] , "a" : '), F.get_json_object("props", "$.k"), F.lit(" }"))
    return read(spark, sf, "events").select("event_id", canonical(raw).alias("canonical"))


@query("validate_template", "SELECT r_regionkey, CASE WHEN contains(r_name, ' ') THEN 'malformed' ELSE 'unknown' END AS problem, r_name AS slot, 16::BIGINT AS place FROM region UNION ALL SELECT r_regionkey, 'missing', 'language', -1 FROM region")
def validate_template(spark, sf):
    def work(batches):
        for b in batches:
            rows = [(k, p, s, at) for k, n in zip(b.r_regionkey, b.r_name, strict=True) for p, s, at in runs.validate_template("{{narrative}} : {{" + n + "}}", {"narrative", "language"}, {"narrative", "language"})]
            yield pd.DataFrame(rows, columns=["r_regionkey", "problem", "slot", "place"])

    return read(spark, sf, "region").select("r_regionkey", "r_name").mapInPandas(work, "r_regionkey int, problem string, slot string, place long")


@query("render_feature_block", "SELECT n_regionkey, '- origin (enum): where from' || chr(10) || string_agg('    ' || n_nationkey || ' = ' || CASE WHEN n_nationkey % 3 = 0 THEN '[no label]' ELSE n_name END, chr(10) ORDER BY n_nationkey) AS block FROM nation GROUP BY 1")
def render_feature_block(spark, sf):
    def work(batches):
        for b in batches:
            codes = [[{"code": str(c["k"]), "labels": {} if c["k"] % 3 == 0 else {"de": c["n"]}} for c in cs] for cs in b.codes]
            yield pd.DataFrame({"n_regionkey": b.n_regionkey, "block": [runs.feature_block([{"key": "origin", "value_type": "enum", "description": "where from", "codes": c}], "de") for c in codes]})

    codes = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("codes"))
    return codes.mapInPandas(work, "n_regionkey int, block string")


@query("output_schema", "SELECT r_regionkey, r_name AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'integer' ELSE 'boolean' END AS first_type FROM region")
def output_schema(spark, sf):
    def work(batches):
        for b in batches:
            types = ["integer" if k % 2 == 0 else "boolean" for k in b.r_regionkey]
            schemas = [extraction.output_schema([(n, t)])["properties"]["features"] for n, t in zip(b.r_name, types, strict=True)]
            yield pd.DataFrame({"r_regionkey": b.r_regionkey, "key": [s["required"][0] for s in schemas], "first_type": [s["properties"][s["required"][0]]["properties"]["value"]["type"][0] for s in schemas]})

    return read(spark, sf, "region").select("r_regionkey", "r_name").mapInPandas(work, "r_regionkey int, key string, first_type string")
