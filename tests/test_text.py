"""Normalising, statistics and small kernels against plain restatements."""

import math
from datetime import date
from decimal import Decimal, getcontext

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from gleanworks import catalog
from gleanworks.functions import stats, text
from gleanworks.operators import review, scrub
from gleanworks.operators.extraction import canonical_answer, parse_output
from gleanworks.plans import texts as plans
from gleanworks.sources import delivery


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expression(F.col("v"))).collect()]


def test_integers(spark):
    given_ = ["+007", "1'250", " 12 000 ", "-0", "x1", "", None, "9" * 40, "1’000", "1_0"]
    assert column(spark, given_, text.normalise_integer) == ["7", "1250", "12000", "0", "x1", "", None, "9" * 40, "1000", "10"]


def test_decimals(spark):
    given_ = ["2,675", "2.665", "1.50", "1'250.5", "abc", "-0.001", "1e2", "100", ".5"]
    assert column(spark, given_, text.normalise_decimal) == ["2.68", "2.66", "1.5", "1250.5", "abc", "-0", "100", "100", "0.5"]


def test_dates_and_times(spark):
    assert column(spark, ["20240229", "20240230", "2024-02-29", "x"], text.normalise_date) == [date(2024, 2, 29).isoformat(), "20240230", "2024-02-29", "x"]
    assert column(spark, ["7:05", "0705", "24:00", "07:05:59", "²:05"], text.normalise_time) == ["425", "425", "24:00", "425", "²:05"]


def test_booleans_and_text(spark):
    assert column(spark, [" Ja", "NON", "maybe"], text.normalise_boolean) == ["true", "false", "maybe"]
    assert column(spark, ["  «Straße»  x ", "...", "ﬁn"], text.normalise_text) == ["strasse» x", "...", "fin"]


def test_empty_values_match_nothing(spark):
    rows = spark.createDataFrame([("a", "a"), ("", "a"), ("a", "  "), (None, None)], "t string, a string")
    assert [r[0] for r in rows.select(text.matches(F.col("t"), F.col("a"), F.lit("enum"), free_text=False)).collect()] == [True, False, False, False]


def test_wilson_solves_its_quadratic(spark):
    getcontext().prec = 40
    z = Decimal(repr(stats.Z))
    cases = [(0, 0), (0, 5), (5, 5), (17, 40), (1370, 1842)]
    low, high = stats.wilson(F.col("k"), F.col("n"))
    for (k, n), r in zip(cases, spark.createDataFrame(cases, "k int, n int").select(low.alias("lo"), high.alias("hi")).collect(), strict=True):
        if n == 0:
            assert (r.lo, r.hi) == (0, 1)
            continue
        p = Decimal(k) / n
        a, b, c = 1 + z * z / n, -(2 * p + z * z / n), p * p
        root = (b * b - 4 * a * c).sqrt()
        assert math.isclose(r.lo, max(0, float((-b - root) / (2 * a))), abs_tol=1e-9) and math.isclose(r.hi, min(1, float((-b + root) / (2 * a))), abs_tol=1e-9)


def test_ties(spark):
    rows = [("f", "a", 0.9, 0.8, 0.95), ("f", "b", 0.7, 0.6, 0.8), ("f", "c", 0.5, 0.4, 0.6), ("g", "a", 0.9, 0.8, 0.95), ("g", "b", 0.1, 0.0, 0.2)]
    got = {(r.feature, r.model): r.mark for r in stats.mark_ties(spark.createDataFrame(rows, "feature string, model string, point double, low double, high double")).collect()}
    assert got == {("f", "a"): "tied", ("f", "b"): "tied", ("f", "c"): "none", ("g", "a"): "best", ("g", "b"): "none"}


def test_ranks_are_peeled_off(spark):
    from gleanworks.operators.ranking import rank_models

    rows = [("a", 0.9, 0.85, 0.95), ("b", 0.84, 0.80, 0.88), ("c", 0.79, 0.75, 0.83), ("d", 0.3, 0.2, 0.4)]
    got = {r.model: r["rank"] for r in rank_models(spark.createDataFrame(rows, "model string, macro double, macro_low double, macro_high double")).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 4}


@given(st.text("ab \n", max_size=30), st.text("ab \n", max_size=4))
@settings(max_examples=200, deadline=None)
def test_spans_hold_the_span(narrative, span):
    for s in review.spans(narrative, span):
        assert narrative[s["start"] : s["end"]].split() == span.split()


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_lines_join_to_the_text(t):
    assert "".join(delivery.physical_lines(t)) == t


@given(st.binary(max_size=40))
@settings(max_examples=200, deadline=None)
def test_decoding_is_strict(data):
    decoded, encoding, refused = delivery.decode(data)
    assert (decoded is None) == (refused is not None)
    if encoding == "utf-8":
        assert decoded.encode() == data.removeprefix(delivery.UTF8_MARK)


def test_refusals():
    assert delivery.decode(b"\xff\xfe\x00\x00a")[2] == ("FILE_UNSUPPORTED_BOM", "utf-32-le")
    assert delivery.decode(b"ab\x00")[2] == ("FILE_CONTAINS_NUL", "2")
    assert delivery.decode(b"ok \x9d")[2] == ("FILE_UNDECODABLE", "3:0x9d")
    assert delivery.decode("für".encode("cp1252"))[:2] == ("für", "cp1252")
    assert delivery.utf8_sequences("aü\nß".encode()) == (2, 1, 1)


def test_parsing_answers():
    features = [("n", "integer"), ("c", "enum"), ("b", "boolean")]
    ok = parse_output('{"features": {"n": {"present": true, "value": 2, "evidence": "two"}, "c": {"present": true, "value": "9"}, "x": {}}, "entities": [{"kind": "car", "attributes": {"a": 1}}, 3]}', features, {"c": ["1"]})
    assert [v["value_raw"] for v in ok["values"]] == ["2", "9", None]
    assert [(i["code"], i["feature_key"]) for i in ok["issues"]] == [("missing_evidence", "c"), ("enum_code_not_in_codelist", "c"), ("missing_feature", "b"), ("unknown_feature", "x")]
    assert ok["entities"] == [{"kind": "car", "ref": None, "attributes": {"a": "1"}}]
    assert [parse_output(x, features)["failure"] for x in ("{", "[]", '{"features": 1}')] == ["invalid_json", "not_an_object", "features_not_object"]
    assert canonical_answer('{"b": 1.0, "a": [true]}') == '{"a":[true],"b":1.0}' and canonical_answer("{") == "!unparsed:{"


def test_masking():
    rules = scrub.Rules(firstnames=("Martin", "Anna"), lastnames=("Simon", "Martin", "Müller", "Nord"), whitelist=("Nord",))
    s = scrub.Scrubber(rules)
    masked, hits = s.scrub("Martin Simon (BE 123456) rief Anna MUELLER an: 079 123 45 67 oder a.b@example.ch; Nord, Herr Nord, Martin.")
    assert masked == "<Firstname_1> <Lastname_1> (<LicensePlate_1>) rief <Firstname_2> <Lastname_2> an: <Phone_1> oder <Email_1>; Nord, Herr <Lastname_3>, <Firstname_1>."
    assert all(masked[h["out_start"] :].startswith(f"<{h['tag']}_{h['number']}>") for h in hits)
    for good in ("BE 123456", "TI123456", "SG 12'345", "+41 (0)44 123 45 67", "044/123 45 67", "x+y@sub.example.org"):
        assert len(s.scrub(good)[1]) == 1, good
    for bad in ("B1", "im Kanton ZH 2 Verletzte", "117", "12.03.2024", "a@b", *scrub.PROTECTED):
        assert not s.scrub(bad)[1], bad


def test_rule_checks():
    bad = [{"id": "Bad!", "tag": "t", "pattern": "("}, {"id": "e", "tag": "Tag", "pattern": "x*"}, {"id": "p", "tag": "Tag", "pattern": "Notruf", "must_match": ["no"]}]
    found = scrub.check_rules(bad, [])
    assert {("Bad!", "id"), ("Bad!", "tag"), ("Bad!", "does not compile"), ("e", "matches nothing at all"), ("p", "must match: no")} <= set(found)
    assert any(r == "p" and "protected" in why for r, why in found)


def scrubbed_texts(spark, texts, rules=scrub.Rules()):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, original string")
    return rows.withColumn("s", scrub.scrubbed(spark, "original", rules)).select("k", "original", "s.*")


def test_examples_are_grouped_by_value(spark):
    rules = scrub.Rules(lastnames=("Meier",))
    rows = scrubbed_texts(spark, ["Herr Meier rief 079 123 45 67 an.", "Herr MEIER und Meier", "079-123-45-67", "neu: 079 123 45 68", None], rules)
    got = {(r.rule_id, r.value): r for r in scrub.scrub_examples(rows, "k").collect()}
    assert {k: (r.hits, r.records) for k, r in got.items()} == {("names-lastname", "Meier"): (3, 2), ("phone", "079 123 45 67"): (2, 2), ("phone", "079 123 45 68"): (1, 1)}
    first = got[("phone", "079 123 45 67")].examples[0]
    assert (first.record_key, first.placeholder, first.before, first.matched, first.after) == ("0", "<Phone_1>", "Herr <Lastname_1> rief", "079 123 45 67", "an.")
    few = scrub.scrub_examples(rows, "k", values=1).where("rule_id = 'phone'").collect()
    assert [(r.value, r.other_hits) for r in few] == [("079 123 45 67", 1)]


def test_slow_rules_are_findings(spark):
    rules = scrub.Rules(patterns=(("slow", "Slow", r"(?:a|aa)+$"),), seconds=0.2)
    rows = scrubbed_texts(spark, ["a" * 60 + "!", "079 123 45 67"], rules)
    assert [(r.code, r.key, r.detail) for r in scrub.scrub_timeouts(rows, "k").collect()] == [("TEXT_SCRUB_TIMEOUT", "0", {"rule_id": "slow"})]
    assert [r.text for r in rows.orderBy("k").collect()] == [None, "<Phone_1>"]


def test_the_masking_function_runs_once(spark):
    rows = scrubbed_texts(spark, ["x"])
    for df in (scrub.scrub_tally(rows, scrub.Rules(), "k"), rows.where("size(hits) > 0").select("text", "hits")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 1


def test_decimals_equal_decimal_arithmetic(spark):
    import decimal
    import random

    rng = random.Random(1)
    values = ["0.00500000000001", "1e-12", "2.675", "2.665", "-0.001", "1,5", "1'000.50", "9.995", "0.995", "99.999", "-0", "+5", "1e3", "12e-1", ".5", "5.", "abc", "", "-.5", "1e-30", "9999999999999.995", "1.2.3", "e5", "+", "."]
    values += [("-" if rng.random() < 0.3 else "") + "".join(rng.choices("0123456789", k=rng.randint(0, 9))) + "." + "".join(rng.choices("0590", k=rng.randint(1, 14))) + rng.choice(["", "", "e3", "E-4"]) for _ in range(300)]

    def expected(v, precision):
        try:
            n = decimal.Decimal(v.translate({ord(c): None for c in text.GROUPING}).replace(",", "."))
        except decimal.InvalidOperation:
            return v.strip()
        return f"{(n if precision is None else round(n, precision)).normalize():f}"

    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for precision in (2, 0, None):
        got = rows.select("v", text.normalise_decimal(F.col("v"), precision).alias("n")).collect()
        assert [(r.v, r.n) for r in got] == [(v, expected(v, precision)) for v in values]


def test_examples_mask_each_text_once(spark, tmp_path):
    spark.createDataFrame([(k, f"Tel. 079 123 45 6{k % 3} und noch 079 123 45 61") for k in range(30)], "k int, original string").write.parquet(f"{tmp_path}/t")
    masked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(t):
        masked.add(len(t))
        return t

    rows = spark.read.parquet(f"{tmp_path}/t").withColumn("original", counted.asNondeterministic()("original"))
    rows = rows.withColumn("s", scrub.scrubbed(spark, "original")).select("k", "original", "s.*")
    found = scrub.scrub_examples(rows, "k", values=1).collect()
    assert [(r.value, r.hits, r.records, r.other_hits) for r in found] == [("079 123 45 60", 10, 10, 50)]
    assert masked.value == 30


def test_a_preview_is_the_tally_with_the_examples(spark, sf):
    got = catalog.QUERIES["scrub_preview"](spark, sf).collect()
    part = {p: [r for r in got if r.part == p] for p in ("records", "rule", "entry", "value")}
    assert [r.part for r in got] == [p for p in part for _ in part[p]]
    assert {(r.rule_id, r.hits, r.records) for r in part["rule"]} == set(map(tuple, catalog.QUERIES["scrub_tally"](spark, sf).collect()))
    most = [tuple(r) for r in catalog.QUERIES["name_match"](spark, sf).collect() if r.hits >= scrub.MOST_HIT]
    assert most and [(r.value, r.hits) for r in part["entry"]] == most
    same = ("rule_id", "value", "hits", "records", "other_hits", "examples")
    listed = scrub.scrub_examples(plans._scrubbed(spark, sf, plans.RULES), "doc_id").select(*same[:-1], plans._shown()).collect()
    assert sorted(tuple(r[c] for c in same) for r in part["value"]) == sorted(map(tuple, listed))
    masked = plans._scrubbed(spark, sf, plans.RULES).where("original <> ''").select("doc_id", (F.size("hits") > 0).alias("hit")).collect()
    assert [(r.records, r.changed, r.timed_out, r.fingerprint) for r in part["records"]] == [(len({r.doc_id for r in masked}), len({r.doc_id for r in masked if r.hit}), None, plans.RULES.fingerprint())]


def test_a_preview_counts_records_and_names_the_slow_rule(spark):
    """A record has two texts, one none, one an empty one; over another a rule takes too long. Only rules that run are listed."""
    rules = scrub.Rules(patterns=(("slow", "Slow", r"(?:a|aa)+$"),), lastnames=("Meier", "Al"), firstnames=("Le",), seconds=0.2)
    rows = [("1", "Herr Meier, 079 123 45 67"), ("1", "Nr. und Tel. 079-123-45-67 MEIER"), ("2", "nichts"), ("3", None), ("4", ""), ("5", "a" * 60 + "!"), ("6", "044 123 45 67 und Meier")]
    df = spark.createDataFrame(rows, "k string, original string").withColumn("s", scrub.scrubbed(spark, "original", rules)).select("k", "original", "s.*")
    got = scrub.scrub_preview(df, rules, "k", least=3, values=1).collect()
    assert [(r.records, r.changed, r.timed_out) for r in got if r.part == "records"] == [(3, 2, "slow")]
    counted = [(r.rule_id, r.tag, r.source, r.hits, r.records) for r in got if r.part == "rule"]
    assert counted == [("license-plate", "LicensePlate", "mandatory", 0, 0), ("phone", "Phone", "mandatory", 3, 2), ("email", "Email", "mandatory", 0, 0), ("slow", "Slow", "imported", 0, 0), ("names-lastname", "Lastname", "list", 3, 2)]
    assert [(r.value, r.hits) for r in got if r.part == "entry"] == [("meier", 3)]
    assert [(r.rule_id, r.value, r.hits, r.records, r.other_hits) for r in got if r.part == "value"] == [("phone", "079 123 45 67", 2, 1, 1), ("names-lastname", "Meier", 3, 2, 0)]
    shown = got[-1].examples
    assert [(e.record_key, e.placeholder, e.before, e.matched, e.after) for e in shown] == [("1", "<Lastname_1>", "Herr", "Meier", ", <Phone_1>"), ("1", "<Lastname_1>", "Nr. und Tel. <Phone_1>", "MEIER", ""), ("6", "<Lastname_1>", "<Phone_1> und", "Meier", "")]
    empty = scrub.scrub_preview(df.where("k IN ('3', '4')"), rules, "k").collect()
    assert [(r.records, r.changed, r.timed_out) for r in empty if r.part == "records"] == [(0, 0, None)] and {r.hits for r in empty if r.part == "rule"} == {0} and len(empty) == 6


def test_a_preview_masks_each_text_once(spark, tmp_path):
    spark.createDataFrame([(k, f"Tel. 079 123 45 6{k % 3}" if k % 2 else "kein Anruf") for k in range(30)], "k int, original string").write.parquet(f"{tmp_path}/t")
    masked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(t):
        masked.add(len(t))
        return t

    rows = spark.read.parquet(f"{tmp_path}/t").withColumn("original", counted.asNondeterministic()("original"))
    rows = rows.withColumn("s", scrub.scrubbed(spark, "original")).select("k", "original", "s.*")
    found = scrub.scrub_preview(rows, scrub.Rules(), "k").collect()
    assert [(r.records, r.changed) for r in found if r.part == "records"] == [(30, 15)] and sum(r.hits for r in found if r.part == "value") == 15
    assert masked.value == 30


def test_workers_hold_texts_in_parts(spark):
    texts = pa.array(["a" * 400_000] * 7 + [None] + ["b" * 3_000_000] + ["c"] * 2500)
    parts = list(scrub.parts(texts))
    assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) <= scrub.PART_ROWS and (len(p) == 1 or sum(map(len, filter(None, p.to_pylist()))) <= scrub.PART_BYTES) for p in parts)
    assert list(scrub.parts(pa.array([], pa.string()))) == []


def test_short_lists_are_looked_for_in_whole_texts(spark):
    rules = scrub.Rules(firstnames=("Erin",), lastnames=("Müller", "Straßer", "O'Neil"))
    texts = ["Erin", "ERINNERN", "Frau MÜLLER", "mueller", "muller", "Strasser", "STRASSER", "STRASSER ß", "Straßer", "Müller", "x 1 2", "É Erín", "O'Neil", "Ωmega", "", None, "SG 12", "SG-1", "sg 1 2", "a@b", "1 2", "12"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("t", scrub.may_match(F.col("t"), rules, rules.index()).alias("may"), scrub.scrubbed(spark, "t", rules).alias("s")).collect()
    work = scrub.Scrubber(rules)
    for r in got:
        assert r.t is None or ((r.s.text, [h.asDict() for h in r.s.hits]) == work.scrub(r.t) and (r.may or not work.scrub(r.t)[1]))
    assert {"ERINNERN", "x 1 2", "", "SG-1", "a@b", "12"} & {r.t for r in got if not r.may} == {"ERINNERN", "x 1 2", ""}


def test_few_columns_of_a_small_file_are_many_tasks(spark, sf):
    from gleanworks.plans import texts as plans

    assert plans._planted(spark, sf).rdd.getNumPartitions() == 4 > spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions()
