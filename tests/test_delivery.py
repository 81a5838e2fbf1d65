"""Files to rows and findings, code lists, exports, freezing, streams."""

import datetime
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gleanworks import streaming
from gleanworks.operators import census, corpus, derive, runs, scoring, scrub
from gleanworks.operators.derive import Filter
from gleanworks.sources import delivery, exports, lists

VOCABULARIES = {"unfall": [("one", ["UnfallUid", "Kanton", "Objekte"])], "objekt": [("one", ["ObjektUid", "UnfallUid", "Art"])], "text": [("one", ["UID", "HERGANG"])]}
KEYS = {"unfall": "UnfallUid", "objekt": "ObjektUid", "text": "UID"}


def key(n):
    return f"ab{n:030d}"


@pytest.fixture()
def files(spark, tmp_path):
    """name -> bytes written; (files, analysed, recovered)."""

    def make(**named):
        for name, data in named.items():
            (tmp_path / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode())
        found = delivery.scan_bytes(spark, str(tmp_path))
        analysed = delivery.analyse_files(found, VOCABULARIES, KEYS).cache()
        rows = delivery.raw_rows(found, VOCABULARIES, KEYS)
        return analysed, delivery.recovered_rows(rows, analysed).orderBy("path", "line_no")

    return make


def test_text_rows_are_recovered(files):
    text = f'UID;HERGANG\r\n{key(1)};plain\r\n{key(2)};"two\r\nlines"\r\n{key(3)};open\r\nmore; here\r\nand more\r\n\r\n{key(4)};a;b\r\n'
    analysed, rows = files(t=text)
    a = analysed.first()
    assert (a.kind, a.delimiter, a.encoding, a.header_ok) == ("text", ";", "utf-8", True)
    got = {r.key: (list(r.fields), r.outcome, r.detail["method"] if r.outcome == "recovered" else None) for r in rows.collect() if r.key}
    assert got[key(1)] == ([key(1), "plain"], "ok", None)
    assert got[key(2)] == ([key(2), "two\r\nlines"], "recovered", "quoted")
    assert got[key(3)] == ([key(3), "open\nmore; here\nand more"], "recovered", "key_anchor")
    assert got[key(4)] == ([key(4), "a;b"], "recovered", "delimiter_in_narrative")
    assert [r.code for r in rows.where("outcome = 'dropped'").collect()] == ["ROW_BLANK_DROPPED"]


def test_structured_rows_are_rejected_not_repaired(files):
    unfall = f"UnfallUid|Kanton|Objekte\n{key(1)}|BE|2\n{key(2)}|ZH|1|9\n{key(3)}|VD|1\nrest|x|y\n"
    _, rows = files(u=unfall)
    got = {r.key: (r.outcome, r.code) for r in rows.collect()}
    assert got == {key(1): ("ok", None), key(2): ("rejected", "ROW_REJECTED_FIELD_COUNT"), key(3): ("rejected", "ROW_REJECTED_FIELD_COUNT")}


def test_parse_errors_and_stray_rows(files):
    text = f'UID;HERGANG\nstray;x\n{key(1)};"bad" quote\n{key(2)};good\n'
    _, rows = files(t=text)
    assert [(r.outcome, r.code) for r in rows.collect()] == [("rejected", "ROW_REJECTED_PARSE_ERROR"), ("rejected", "ROW_REJECTED_PARSE_ERROR"), ("ok", None)]


def test_file_findings(files):
    analysed, _ = files(a=b"\xff\xfea", b=b"x\x00", c="A;B\n1;2\n", d="UID;HERGANG\n" + key(1) + ";für ".encode().decode(), e=("UID;HERGANG\n" + key(2) + ";ü").encode() + b" \xfc")
    found = {(r.path[-5], r.code) for r in delivery.file_findings(analysed).collect()}
    assert found == {("a", "FILE_UNSUPPORTED_BOM"), ("b", "FILE_CONTAINS_NUL"), ("c", "UNKNOWN_HEADER"), ("e", "UTF8_READ_AS_CP1252")}


def test_sniffing():
    assert delivery.sniff("a|b;c\n1|2;3\n") == "|" and delivery.sniff("a,b,c\n1,2,3\n") == "," and delivery.sniff("only") == "|"
    found = delivery.classify_header([" uid", "Hergang", "extra"], VOCABULARIES)
    assert (found["kind"], found["ok"], found["extra"]) == ("text", False, ["extra"])


def test_preview(spark, tmp_path):
    (tmp_path / "p.csv").write_text("one\ntwo\nthree\n")
    assert delivery.preview(delivery.scan_bytes(spark, str(tmp_path)), 2, str.upper).first().lines == ["ONE", "TWO"]


def test_codelists(spark):
    good = {"Witter": {"chapter": "3", "name": {"de": "Wetter"}, "codes": {"1": {"de": "schön", "fr": "beau"}, "2": {"de": "Regen"}}}}
    rows = lists.read_codelist(spark, json.dumps(good))
    assert rows.count() == 2
    assert lists.check_codelist('{"a": {"name": {}}, "b": {"codes": {"1": {"xx": "y"}}}}')[1] == ["a: codes missing", "b.1: labels"]


def test_name_list(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# list\nMüller\nMueller\nAb\nAnna # first\n\n")
    assert sorted(r.key for r in lists.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["anna", "mueller"]
    assert lists.read_rules(b"[[rule]]\nid='r'\ntag='Tag'\npattern='xyz+'\nmust_match=['xyzz']\n")[0][0]["id"] == "r"
    with pytest.raises(ValueError, match="unknown field"):
        lists.read_rules(b"odd=1\n")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("C", "block", "k", 1, {"b": "2", "a": "1"})], "code string, severity string, key string, line_no int, detail map<string,string>")
    path = tmp_path / "f.csv"
    exports.export("findings", rows, f"{path}.parts", "secret", "corpus x")
    exports.gather(spark, f"{path}.parts", str(path))
    assert path.read_bytes() == b"\xef\xbb\xbf# secret\r\n# corpus x\r\ncode;severity;key;line_no;detail\r\nC;block;k;1;a=1|b=2\r\n"


def test_freeze_is_all_or_nothing(spark, tmp_path):
    records = spark.range(3)
    finding = lambda code: spark.createDataFrame([(code,)], "code string")
    with pytest.raises(ValueError, match="ORPHAN_FK"):
        corpus.freeze(spark, {"record": records}, finding("ORPHAN_FK"), f"{tmp_path}/bad", {})
    assert not (tmp_path / "bad").exists()
    corpus.freeze(spark, {"record": records}, finding("ROW_RECOVERED"), f"{tmp_path}/good", {"name": "n"})
    assert corpus.read_corpus(spark, f"{tmp_path}/good", "record").count() == 3


def test_scores_replace_their_partitions(spark, tmp_path):
    rows = lambda v, f: spark.createDataFrame([("r", f, v)], "run_id string, feature_id string, value int")
    for v, f in ((1, "a"), (2, "b"), (3, "a")):
        scoring.write_scores(rows(v, f), str(tmp_path / "s"))
    assert sorted((r.feature_id, r.value) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 3), ("b", 2)]


def test_derivations_raise_on_unknown_codes(spark):
    records, children = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, None), (1, " ")], "k int, c string")
    assert {r.k: r.value for r in derive.derive_ordinal(records, children, "k", "c", ["w", "x"]).collect()} == {1: "x", 2: None}
    assert {r.k: r.value for r in derive.derive_count(records, children, "k", Filter("c", "is_empty")).collect()} == {1: "2", 2: "0"}
    with pytest.raises(Exception, match="absent from the declared order"):
        derive.derive_ordinal(records, children, "k", "c", ["w"]).collect()


def test_prompts(spark):
    assert runs.validate_template("a {{x}} {{y}} {{}} {{", {"x"}, {"x", "z"}) == [("unknown", "y", 8), ("empty", "", 14), ("malformed", "{{", 19), ("missing", "z", -1)]
    assert "[no label]" in runs.feature_block([{"key": "k", "value_type": "enum", "codes": [{"code": "1", "labels": {}}]}], "de")
    with pytest.raises(Exception, match="different records"):
        one = spark.createDataFrame([(1, "a")], "k int, v string")
        runs.differ_count(one, one.where("false"), "k", "v").collect()


def test_empty_tables(spark, sf):
    cells = census.melt_cells(spark.createDataFrame([], "k string, v double"), "t", "k")
    values = census.value_table(cells, F.lit(0))
    headers = spark.createDataFrame([("t", "k"), ("t", "v")], "table_name string, column_name string")
    assert {r.bucket for r in census.census_columns(values, headers, F.lit(0)).collect()} == {"empty"}
    assert {r.type_hint for r in census.type_hints(values, headers).collect()} == {"text"}


def test_type_hints(spark):
    cols = {"UnfTypAusw": ["x"], "d": ["20240230", "01.02.68"], "t": ["23:59"], "i": ["1'000", " 7", "1_0"], "f": ["1e5", "nan", ".5"], "n": ["12f", "1d"], "e": [""]}
    rows = [("t", c, v, 1, 0) for c, vs in cols.items() for v in vs if v]
    values = spark.createDataFrame(rows, "table_name string, column_name string, value_raw string, n long, first long")
    headers = spark.createDataFrame([("t", c) for c in cols], "table_name string, column_name string")
    assert {r.column_name: r.type_hint for r in census.type_hints(values, headers).collect()} == {"UnfTypAusw": "enum", "d": "date", "t": "time", "i": "integer", "f": "decimal", "n": "text", "e": "text"}


def test_stream_parses_each_answer_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, v: json.dumps({"run_id": "r", "record_id": str(i), "raw": json.dumps({"features": {"k": {"present": True, "value": v}}}), "answered_at": "2024-01-01T00:00:00"})
    (tmp_path / "in/a.json").write_text("\n".join([line(1, 5), line(1, 5), line(2, None)]))
    run = lambda: streaming.write_extractions(streaming.parsed_answers(streaming.read_answers(spark, str(tmp_path / "in")), [("k", "integer")]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text(line(3, 1))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.record_id, r.values[0].value_raw) for r in got) == [("1", "5"), ("2", None), ("3", "1")]


def test_islands_over_the_borders_of_blocks(spark, monkeypatch):
    """Rows belong together wherever blocks of lines end."""
    import random

    rng = random.Random(3)
    rows = []
    for path in ("a", "b"):
        for line in range(1, 60):
            kind = rng.random()
            fields = [f"{line:032d}", "text"] if kind < 0.35 else [f"more {line}"]
            rows.append((path, "text" if path == "a" else "objekt", ";", line, fields, 1, "bad" if kind > 0.95 else None))
    df = spark.createDataFrame(rows, delivery.ROWS)
    files = spark.createDataFrame([(p, 0, ["UID", "HERGANG"]) for p in "ab"], "path string, key_index int, header array<string>")
    found = lambda: sorted(map(repr, delivery.recovered_rows(df, files).collect()))
    whole = found()
    monkeypatch.setattr(delivery, "BLOCK_LINES", 4)
    assert found() == whole and len(whole) > 30


def test_a_long_file_is_no_task_of_its_own(spark):
    """Rows meet what is known of their file without a shuffle by path, whatever Spark takes the sizes for."""
    import re

    df = spark.createDataFrame([("a", "text", ";", k, [f"{k:032d}", "x"], 1, None) for k in range(50)], delivery.ROWS)
    files = spark.createDataFrame([("a", 0, ["UID", "HERGANG"])], "path string, key_index int, header array<string>")
    found = delivery.recovered_rows(df, files)
    assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[path#\d+\], \[path#\d+\]", found._jdf.queryExecution().executedPlan().toString())
    assert found.where("outcome = 'ok'").count() == 50


def test_freeze_delivery(spark, tmp_path):
    """The freeze masks, detects and counts in one step, keeps no original text, and a slow rule leaves no corpus."""
    texts = {"r1": "Herr Simon rief 079 123 45 67 an, er ist in der Stadt und wartet", "r2": "", "r3": "a" * 60 + "!"}
    records = spark.createDataFrame([(k, t, False) for k, t in texts.items()], "record_key string, narrative string, from_anonymised boolean")
    cells = spark.createDataFrame([("unfall", "r1", "anonym", "Tel. 044 123 45 67", 1), ("unfall", "r2", "anonym", "", 2), ("unfall", "r1", "ort", "044 123 45 67", 3)], "table_name string, record_key string, column_name string, value_raw string, seq long")
    none = spark.createDataFrame([], "code string, detail map<string,string>")
    rules = scrub.Rules(lastnames=("Simon",))
    entry = corpus.freeze_delivery(spark, records, cells, none, f"{tmp_path}/c", {"name": "n"}, rules=rules, anonymised=("anonym",))
    assert entry["record_count"] == 3 and entry["language_counts"] == {"de": 1, "und": 1, "mixed": 1} and entry["is_dev_sized"]
    read = lambda t: corpus.read_corpus(spark, f"{tmp_path}/c", t)
    assert {r.record_key: r.narrative for r in read("record").collect()}["r1"] == "Herr <Lastname_1> rief <Phone_1> an, er ist in der Stadt und wartet"
    assert sorted((r.column_name, r.value_raw) for r in read("cell").collect()) == [("anonym", ""), ("anonym", "Tel. <Phone_1>"), ("ort", "044 123 45 67")]
    tally = {r.rule_id: (r.hits, r.records) for r in read("scrub-tally").collect()}
    assert tally["phone"] == (2, 1) and tally["names-lastname"] == (1, 1) and tally["email"] == (0, 0)
    assert "Simon" not in "".join(str(r) for r in read("record").collect())
    slow = scrub.Rules(patterns=(("slow", "Slow", r"(?:a|aa)+$"),), seconds=0.2)
    with pytest.raises(ValueError, match="TEXT_SCRUB_TIMEOUT"):
        corpus.freeze_delivery(spark, records, cells, none, f"{tmp_path}/d", {"name": "n"}, rules=slow)
    assert not (tmp_path / "d" / "manifest").exists()
    blocking = spark.createDataFrame([("ORPHAN_FK", None)], "code string, detail map<string,string>")
    with pytest.raises(ValueError, match="ORPHAN_FK"):
        corpus.freeze_delivery(spark, records, cells, blocking, f"{tmp_path}/e", {"name": "n"})
    assert not (tmp_path / "e").exists()


@pytest.mark.parametrize("linked", [("file",), ()], ids=["link", "rename"])
def test_a_version_has_one_writer(spark, tmp_path, monkeypatch, linked):
    """A number that is taken is refused, whichever way names are taken, and nothing of the attempt stays."""
    monkeypatch.setattr(corpus, "LINKED", linked)
    out = f"file://{tmp_path}/c"
    assert corpus.manifests(spark, out).collect() == []
    assert corpus._claimed(spark, out, 1, '{"a": "ö"}')
    assert not corpus._claimed(spark, out, 1, '{"a": "other"}')
    assert sorted(f.name for f in (tmp_path / "c" / "manifest").iterdir() if not f.name.endswith(".crc")) == ["00000001.json"]
    assert corpus.snapshot(spark, out) == {"a": "ö"}
    with pytest.raises(LookupError):
        corpus.snapshot(spark, out, 2)
    with pytest.raises(LookupError):
        corpus.snapshot(spark, f"{tmp_path}/none")


def test_writers_at_once_get_a_version_each(spark, tmp_path):
    out = f"{tmp_path}/c"
    none = spark.createDataFrame([], "code string")
    freeze = lambda k: corpus.freeze(spark, {"record": spark.range(k, k + 3).withColumnRenamed("id", "n")}, none, out, {"name": "n", "writer": k})
    first = freeze(100)
    held = corpus.snapshot(spark, out)
    with ThreadPoolExecutor(6) as pool:
        entries = list(pool.map(freeze, range(6)))
    assert sorted(e["version"] for e in entries) == [2, 3, 4, 5, 6, 7] and first["version"] == 1
    assert sorted(r.version for r in corpus.manifests(spark, out).collect()) == list(range(1, 8))
    for e in entries:
        assert corpus.snapshot(spark, out, e["version"]) == e
        assert sorted(r.n for r in corpus.read_corpus(spark, out, "record", e["version"]).collect()) == [e["writer"] + i for i in range(3)]
    assert held == first and sorted(r.n for r in corpus.read_corpus(spark, out, "record", held).collect()) == [100, 101, 102]
    last = next(e for e in entries if e["version"] == 7)
    assert corpus.read_corpus(spark, out, "record").agg(F.min("n")).first()[0] == last["writer"]


def test_derivation_catalogue():
    specs = [
        derive.Derivation("count_objects"), derive.Derivation("any_person_matches", derive.Filter("c", "in", ("1", "2"))), derive.Derivation("any_object_matches", derive.Filter("c", "is_empty")),
        derive.Derivation("min_ordinal", None, "person", "c", ("b", "a")), derive.Derivation("distinct_count", None, "objekt", "c"),
    ]
    for spec in specs:
        assert derive.derivation_from_json(spec.to_json()) == spec
    for bad in ('{"type": "mean"}', '{"type": "distinct_count", "table": "objekt"}', '{"type": "any_object_matches", "filter": null}', '{"type": "max_ordinal", "table": "objekt", "column": "c", "ordered_codes": ["a", "a"]}', "[]"):
        with pytest.raises(ValueError):
            derive.derivation_from_json(bad)


def test_columns_are_counted_as_what_they_hold(spark):
    """Counts of each column are those of its cells as text, and no cell becomes a row or a text of its own."""
    rows = [(k, [None, "", "a", "B"][k % 4], [0.004, -0.001, 1.5, None][k % 4], bool(k % 2), datetime.datetime(2020, 1, 1 + k % 3), datetime.date(2021, 1, 1 + k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, s string, d double, b boolean, t timestamp, day date")
    cells = census.value_table(census.melt_cells(df, "x", "k"), F.col("row_key").cast("long"))
    columns = census.column_counts(df, "x", "k")
    counted = columns[0]
    for c in columns[1:]:
        counted = counted.unionAll(c)
    names = ["table_name", "column_name", "value_raw", "n", "first"]
    assert sorted(map(tuple, counted.select(names).collect())) == sorted(map(tuple, cells.select(names).collect()))
    assert sorted(map(tuple, census.top_of_columns(columns, 3).collect())) == sorted(map(tuple, census.top_values(cells, 3).collect()))
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()


def test_duplicate_keys_are_dealt_to_all_partitions(spark):
    """However few bytes the keys take, their counts are the work of as many tasks as the session asks for."""
    from gleanworks.operators import integrity

    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", None), ("b", 3), ("b", 3)], "file string, key long")
    found = integrity.duplicate_keys(rows, ["key"], "file")
    assert sorted((r.key, r.n, r.files) for r in found.collect()) == [(1, 2, ["a", "b"]), (3, 2, ["b"])]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_persons_are_counted_by_object(spark):
    from gleanworks.operators import integrity

    unfall = spark.createDataFrame([("u", 1, "2", "3"), ("u", 2, "1", "4"), ("u", 3, "0", "x")], "file string, key long, objects string, persons string")
    objekt = spark.createDataFrame([("o", 10, 1), ("o", 11, 1), ("o", 12, 2)], "file string, key long, parent long")
    person = spark.createDataFrame([("p", 100 + k, o) for k, o in enumerate([10, 10, 11, 12, 12, None, 99])], "file string, key long, parent long")
    found = integrity.validate_delivery(unfall, objekt, person, spark.createDataFrame([("t", k) for k in (1, 2, 3)], "file string, key long")).collect()
    assert {(r.code, r.key, r.detail.get("declared"), r.detail.get("actual")) for r in found if r.code.startswith("COUNT")} == {("COUNT_MISMATCH_PERS", "2", "4", "2")}
    # counted before they are joined: the join's rows are objects
    assert integrity.count_mismatches(unfall, objekt.selectExpr("parent", "CAST(2 AS long) AS n"), "key", "parent", "objects", "n").collect()[0].actual in (2, 4)
