"""Queries on reading files: documents stand in for delivered bytes, orders for the rows of files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..catalog import query, read, scratch_dir
from ..sources import delivery, lists, ranges

VOCABULARIES = {"text": [("one", ["UID", "HERGANG"])]}
KEYS = {"text": "UID"}


def _bytes(spark, sf):
    """Documents as files: odd ones UTF-8, even ones Windows-1252, some with a NUL or a mark that is refused."""
    kind = F.col("doc_id") % 40
    body = F.when(F.col("doc_id") % 2 == 1, F.encode("text", "utf-8")).otherwise(F.encode(F.col("text"), "iso-8859-1"))
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), body)).when(kind == 1, F.concat(body, F.unhex(F.lit("00")))).otherwise(body)
    return read(spark, sf, "documents").select("doc_id", content.alias("content"))


@query("detect_encoding", r"SELECT doc_id, CASE WHEN doc_id % 40 > 1 THEN CASE WHEN doc_id % 2 = 1 OR NOT regexp_matches(text, '[^\x00-\x7F]') THEN 'utf-8' ELSE 'cp1252' END END AS encoding, CASE doc_id % 40 WHEN 0 THEN 'FILE_UNSUPPORTED_BOM' WHEN 1 THEN 'FILE_CONTAINS_NUL' END AS refused FROM documents")
def detect_encoding(spark, sf):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [delivery.decode(bytes(c)) for c in b.content]
            yield pd.DataFrame({"doc_id": b.doc_id, "encoding": [e for _, e, _ in found], "refused": [r[0] if r else None for _, _, r in found]})

    return _bytes(spark, sf).mapInPandas(work, "doc_id long, encoding string, refused string")


@query("refuse_bytes", "SELECT doc_id FROM documents WHERE doc_id % 40 <= 1")
def refuse_bytes(spark, sf):
    content = F.col("content")
    marks = [F.unhex(F.lit(m.hex())) for m, _ in delivery.WIDE_MARKS]
    starts = F.startswith(content, marks[0])
    for m in marks[1:]:
        starts = starts | F.startswith(content, m)
    return _bytes(spark, sf).where(starts | F.contains(content, F.unhex(F.lit("00")))).select("doc_id")


@query("utf8_sequences", r"SELECT doc_id, (length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS n FROM documents")
def utf8_sequences(spark, sf):
    """Every document as the UTF-8 bytes that are to be found in a file read as Windows-1252; some hold single bytes of
    that encoding too, which are no sequences, and some two more sequences of four bytes."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n": [delivery.utf8_sequences(bytes(c))[0] for c in b.content]})

    stray = F.unhex(F.lit("20E420FC20"))
    more = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("F09F9880F09F9A97"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode("text", "utf-8"), stray, more)
    return read(spark, sf, "documents").select("doc_id", content.alias("content")).mapInPandas(work, "doc_id long, n long")


_KEY = "lpad(CAST(o_orderkey AS STRING), 32, '0')"


@query("recover_rows", """SELECT path, line_no, "key", outcome FROM (SELECT o_orderstatus AS path, o_orderkey AS line_no, a, f, lpad(CAST(o_orderkey AS VARCHAR), 32, '0') AS k,
 CASE WHEN NOT a THEN 'rejected' WHEN nxt THEN 'recovered' WHEN f THEN 'recovered' ELSE 'ok' END AS outcome, CASE WHEN a THEN lpad(CAST(o_orderkey AS VARCHAR), 32, '0') END AS "key", seen
 FROM (SELECT *, o_orderkey % 5 <> 0 AS a, o_orderkey % 7 = 0 AS f, lead(o_orderkey % 5 = 0) OVER w AS nxt, sum(CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END) OVER w AS seen FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey))) WHERE a OR seen = 0""")
def recover_rows(spark, sf):
    anchored = F.col("o_orderkey") % 5 != 0
    tail = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("more"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    fields = F.concat(F.array(F.when(anchored, F.expr(_KEY)).otherwise("rest of a line"), F.col("o_orderpriority")), tail)
    rows = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("path"), F.lit("text").alias("kind"), F.lit(";").alias("delimiter"), F.col("o_orderkey").cast("int").alias("line_no"), fields.alias("fields"), F.lit(1).alias("line_span"), F.lit(None).cast("string").alias("error"))
    files = spark.createDataFrame([(s, 0, ["UID", "HERGANG"]) for s in "FOP"], "path string, key_index int, header array<string>")
    return delivery.recovered_rows(rows, files).select("path", F.col("line_no").cast("long").alias("line_no"), "key", "outcome")


@query("classify_header", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'unknown' ELSE 'text' END AS kind, o_orderkey % 4 = 0 AS ok, CASE o_orderkey % 4 WHEN 2 THEN o_orderpriority ELSE '' END AS extra,
 CASE o_orderkey % 4 WHEN 1 THEN 'HERGANG|Hergang' ELSE '' END AS duplicated FROM orders""")
def classify_header(spark, sf):
    """A header for each order: as expected but for case and blanks, with a column twice, with one more, of other columns."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            headers = [(["uid ", "hergang"], ["UID", "HERGANG", "Hergang"], ["UID", "HERGANG", n], [n, "x"])[k % 4] for k, n in zip(b.o_orderkey, b.o_orderpriority, strict=True)]
            found = [delivery.classify_header(h, VOCABULARIES) for h in headers]
            yield pd.DataFrame({"o_orderkey": b.o_orderkey, "kind": [f["kind"] for f in found], "ok": [f["ok"] for f in found], "extra": ["|".join(f["extra"]) for f in found], "duplicated": ["|".join(f["duplicated"]) for f in found]})

    return read(spark, sf, "orders").select("o_orderkey", "o_orderpriority").mapInPandas(work, "o_orderkey long, kind string, ok boolean, extra string, duplicated string")


@query("column_index", "SELECT o_orderkey, (o_orderkey % 3)::BIGINT AS at FROM orders WHERE o_orderkey % 4 <> 0")
def column_index(spark, sf):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = ["A", " Unfall-UID ", "c"]
            at = [delivery.column_index([names[(i + 1 - k % 3) % 3] for i in range(3)], "unfall-uid" if k % 4 else "gone") for k in b.o_orderkey]
            yield pd.DataFrame({"o_orderkey": b.o_orderkey, "at": pd.array(at, "Int64")})

    return read(spark, sf, "orders").select("o_orderkey").mapInPandas(work, "o_orderkey long, at long").where("at IS NOT NULL")


@query("split_physical_lines", r"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END + 3)::BIGINT AS n FROM documents")
def split_physical_lines(spark, sf):
    """Three more lines each, ended by CR, CRLF and LF; other separators end none."""
    @F.pandas_udf("long")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(delivery.physical_lines("a\u2028\r\x0b\r\nb\x85\n" + t)))

    return read(spark, sf, "documents").select("doc_id", lines("text").alias("n"))


@query("detect_dialect", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN ',' WHEN 3 THEN chr(9) ELSE '|' END AS delimiter FROM orders")
def detect_dialect(spark, sf):
    """Lines of an order under each delimiter, with another one inside quotes; one line without any is of the usual kind."""
    def text(k: int, status: str, priority: str) -> str:
        d = "|;,\t"[k % 5 % 4]
        other = "|" if d != "|" else ";"
        rows = [["key", "status", "priority"], [str(k), status, f'"a{other}b{other}c{other}d"'], ["1", "2", priority]]
        return "only one field\n" if k % 5 == 4 else "\n".join(d.join(r) for r in rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"o_orderkey": b.o_orderkey, "delimiter": [delivery.sniff(text(*x), "unfall") for x in zip(b.o_orderkey, b.o_orderstatus, b.o_orderpriority, strict=True)]})

    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").mapInPandas(work, "o_orderkey long, delimiter string")


@query("read_rows", """SELECT o_orderkey, line_no, n_fields, span, last FROM (SELECT o_orderkey, unnest([1, 2, 4, 5]) AS line_no, unnest([2, 2, 3, 2])::BIGINT AS n_fields, unnest([1, 2, 1, 1])::BIGINT AS span,
 unnest(['b', 'one' || chr(10) || 'two "' || o_orderstatus || '"', '', o_orderpriority]) AS last FROM orders)""")
def read_rows(spark, sf):
    """Quotes doubled inside quotes, a line end inside quotes, an empty last field, every kind of line end."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s, p in zip(b.o_orderkey, b.o_orderstatus, b.o_orderpriority, strict=True):
                text = f'a;b\r\n{k};"one\ntwo ""{s}"""\r\nx;y;\rz;{p}'
                rows += [(k, line, len(fields), span, fields[-1]) for line, fields, span, _ in delivery.read_rows(text, ";")]
            yield pd.DataFrame(rows, columns=["o_orderkey", "line_no", "n_fields", "span", "last"])

    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").mapInPandas(work, "o_orderkey long, line_no int, n_fields long, span long, last string")


def _files(spark, sf):
    """Each customer as a file: UTF-8 or Windows-1252, with or without mark, semicolons, one without its second column."""
    k = F.col("c_custkey")
    head = F.when(k % 5 == 0, "UID;OTHER").when(k % 7 == 0, "foo;bar;baz").otherwise("UID;HERGANG")
    text = F.concat(head, F.lit("\r\n"), F.expr("lpad(CAST(c_custkey AS STRING), 32, '0')"), F.lit(";Zürich "), F.col("c_name"), F.lit("\r\n"))
    content = F.when(k % 2 == 0, F.encode(text, "iso-8859-1")).when(k % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "utf-8"))).otherwise(F.encode(text, "utf-8"))
    return read(spark, sf, "customer").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), content.alias("content"))


@query("analyse_file", """SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'cp1252' ELSE 'utf-8' END AS encoding, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AS had_mark, ';' AS delimiter,
 CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'unknown' ELSE 'text' END AS kind, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS header_ok FROM customer""")
def analyse_file(spark, sf):
    return delivery.analyse_files(_files(spark, sf), VOCABULARIES, KEYS).select("path", "encoding", "had_mark", "delimiter", "kind", "header_ok")


@query("file_findings", "SELECT 'f' || c_custkey AS path, 'UNKNOWN_HEADER' AS code, CASE WHEN c_custkey % 5 = 0 THEN 'UID|OTHER' ELSE 'foo|bar|baz' END AS header FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def file_findings(spark, sf):
    found = delivery.file_findings(delivery.analyse_files(_files(spark, sf), VOCABULARIES, KEYS))
    return found.select("path", "code", F.col("detail")["header"].alias("header"))


@query("delivery_preview", "SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'UID;OTHER' WHEN c_custkey % 7 = 0 THEN 'foo;bar;baz' ELSE 'UID;HERGANG' END || '/' || lpad(CAST(c_custkey AS VARCHAR), 32, '0') || ';Zürich ' || c_name AS shown FROM customer")
def delivery_preview(spark, sf):
    return delivery.preview(_files(spark, sf), 2).select("path", F.array_join("lines", "/").alias("shown"))


@query("override_recovery", "SELECT path, setting, detected, effective FROM (SELECT 'f' || c_custkey AS path, 'encoding' AS setting, CASE WHEN c_custkey % 2 = 0 THEN 'cp1252' ELSE 'utf-8' END AS detected, 'cp1252' AS effective FROM customer) WHERE detected <> effective")
def override_recovery(spark, sf):
    files = _files(spark, sf)
    found = delivery.analyse_files(files, VOCABULARIES, KEYS)
    return delivery.override_findings(found, found.withColumn("encoding", F.lit("cp1252"))).select("path", "setting", "detected", "effective")


@query("drop_blank_rows", "SELECT o_orderstatus AS path, count(*) FILTER (WHERE o_orderkey % 6 = 0)::BIGINT AS dropped, count(*) FILTER (WHERE o_orderkey % 6 <> 0)::BIGINT AS kept FROM orders GROUP BY 1")
def drop_blank_rows(spark, sf):
    fields = F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.expr(_KEY), F.col("o_orderpriority")))
    rows = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("path"), F.lit("text").alias("kind"), F.lit(";").alias("delimiter"), F.col("o_orderkey").cast("int").alias("line_no"), fields.alias("fields"), F.lit(1).alias("line_span"), F.lit(None).cast("string").alias("error"))
    files = spark.createDataFrame([(s, 0, ["UID", "HERGANG"]) for s in "FOP"], "path string, key_index int, header array<string>")
    blank = F.coalesce(F.col("code") == "ROW_BLANK_DROPPED", F.lit(False))
    return delivery.recovered_rows(rows, files).groupBy("path").agg(F.count_if(blank).alias("dropped"), F.count_if(~blank).alias("kept"))


@query("scan_bytes", "SELECT 'region.parquet' AS file, 'PAR1' AS magic UNION ALL SELECT 'nation.parquet', 'PAR1'")
def scan_bytes(spark, sf):
    found = delivery.scan_bytes(spark, f"{sf}/region.parquet").union(delivery.scan_bytes(spark, f"{sf}/nation.parquet"))
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.decode(F.substring("content", 1, 4), "utf-8").alias("magic"))


@query("json_codelist_scan", "SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS n_rows, CASE WHEN n_nationkey % 4 = 0 THEN 'codes missing' ELSE '' END AS error FROM nation")
def json_codelist_scan(spark, sf):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [json.dumps({n: {"name": {"de": n}, **({} if k % 4 == 0 else {"codes": {"1": {"de": "a"}, "2": {}}})}}) for k, n in zip(b.n_nationkey, b.n_name, strict=True)]
            found = [lists.check_codelist(r) for r in raw]
            yield pd.DataFrame({"n_nationkey": b.n_nationkey, "n_regionkey": b.n_regionkey, "n_rows": [len(rows) for rows, _ in found], "error": ["; ".join(e.split(": ", 1)[1] for e in errors) for _, errors in found]})

    return read(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name").mapInPandas(work, "n_nationkey int, n_regionkey int, n_rows long, error string")


@query("toml_rules_scan", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'error' ELSE 'r' || n_nationkey END AS outcome FROM nation")
def toml_rules_scan(spark, sf):
    def outcome(k: int) -> str:
        text = f"version = 1\n[[rule]]\nid = 'r{k}'\ntag = 'Tag'\npattern = 'case-{k}-[0-9]+'\nmust_match = ['case-{k}-7']\n" + ("odd = 1\n" if k % 3 == 0 else "")
        try:
            return lists.read_rules(text.encode())[0][0]["id"]
        except ValueError:
            return "error"

    @F.pandas_udf("string")
    def scanned(keys: pd.Series) -> pd.Series:
        return keys.map(outcome)

    return read(spark, sf, "nation").select("n_nationkey", scanned("n_nationkey").alias("outcome"))


@query("name_list_scan", "SELECT lower(c_mktsegment) AS key, min(c_mktsegment) AS entry FROM customer GROUP BY 1")
def name_list_scan(spark, sf):
    """A list with a mark, comments, repeats and entries of few letters."""
    folder = scratch_dir(spark, "names")
    c = read(spark, sf, "customer")
    lines = c.select(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " # note").otherwise("")).alias("value")).union(spark.createDataFrame([("# a comment",), ("ab",), ("",)], "value string"))
    lines.write.text(folder)
    return lists.read_names(spark, folder).select("key", "entry")


@query("read_ranges", """SELECT lpad(CAST(o_orderkey AS VARCHAR), 32, '0') AS uid, 'status ' || o_orderstatus || chr(10) || 'said "' || o_orderpriority || '"; done' AS narrative, 2 AS line_span FROM orders""")
def read_ranges(spark, sf):
    """The orders as one file, with a line end, quotation marks and delimiters inside quotes, read back by ranges."""
    path = scratch_dir(spark, "ranges")
    quoted = F.concat(F.lit('"status '), "o_orderstatus", F.lit('\nsaid ""'), "o_orderpriority", F.lit('""; done"'))
    rows = read(spark, sf, "orders").select(F.concat_ws(";", F.lpad(F.col("o_orderkey").cast("string"), 32, "0"), quoted).alias("value"))
    spark.createDataFrame([("UID;HERGANG",)], "value string").coalesce(1).union(rows.coalesce(1)).coalesce(1).write.text(path)
    found = ranges.Delivery(spark, path, VOCABULARIES, KEYS).rows()
    return found.select(F.col("fields")[0].alias("uid"), F.col("fields")[1].alias("narrative"), "line_span")
