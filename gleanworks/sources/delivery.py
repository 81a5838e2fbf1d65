"""Reading delivered files: bytes to rows and findings, strictly, every repair reported.

Files are independent, so each is read by one task from Spark's binary source. Reassembling rows that continue over
lines is a sessionisation over the file's rows, in blocks of lines: a row whose key is a key starts an island, others
belong to the last.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("unfall", "objekt", "person", "text")
#: Byte order marks that are refused, longest first, and delimiters in order of preference.
WIDE_MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DELIMITERS = ("|", ";", ",", "\t")
USUAL = {"unfall": "|", "objekt": "|", "person": "|", "text": ";"}
KEY = r"^[0-9a-fA-F]{32}$"
SNIFFED_LINES = 10
KNOWN_SHARE = 0.6
UTF8_MARK = b"\xef\xbb\xbf"

ROWS = "path string, kind string, delimiter string, line_no int, fields array<string>, line_span int, error string"
FILES = "path string, encoding string, had_mark boolean, delimiter string, kind string, vocabulary string, header array<string>, header_ok boolean, missing array<string>, extra array<string>, duplicated array<string>, key_index int, utf8_sequences long, first_utf8_offset long, first_utf8_line long, refused string, refused_detail string"


def scan_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def refuse(data: bytes) -> tuple[str, str] | None:
    """Why bytes are not decoded at all: (finding code, detail)."""
    for mark, name in WIDE_MARKS:
        if data.startswith(mark):
            return "FILE_UNSUPPORTED_BOM", name
    at = data.find(0)
    return ("FILE_CONTAINS_NUL", str(at)) if at >= 0 else None


def decode(data: bytes, encoding: str | None = None) -> tuple[str | None, str | None, tuple[str, str] | None]:
    """(text, encoding, refusal): strict UTF-8, then strict Windows-1252, or only the encoding asked for."""
    refused = refuse(data)
    if refused:
        return None, None, refused
    body = data.removeprefix(UTF8_MARK)
    failed = None
    for name in [encoding] if encoding else ["utf-8", "cp1252"]:
        try:
            return body.decode(name), name, None
        except UnicodeDecodeError as e:
            failed = e.start
    at = failed + len(data) - len(body)
    return None, None, ("FILE_UNDECODABLE", f"{at}:0x{data[at]:02x}")


#: Well-formed sequences of more than one byte (RFC 3629).
_TAIL = rb"[\x80-\xbf]"
_MULTIBYTE = re.compile(rb"[\xc2-\xdf]" + _TAIL + rb"|(?:\xe0[\xa0-\xbf]|\xed[\x80-\x9f]|[\xe1-\xec\xee\xef]" + _TAIL + rb")" + _TAIL + rb"|(?:\xf0[\x90-\xbf]|\xf4[\x80-\x8f]|[\xf1-\xf3]" + _TAIL + rb")" + _TAIL + _TAIL)


def utf8_sequences(data: bytes) -> tuple[int, int | None, int | None]:
    """(how many, offset of the first, its line): text read as Windows-1252 that was UTF-8."""
    places = [m.start() for m in _MULTIBYTE.finditer(data, len(UTF8_MARK) if data.startswith(UTF8_MARK) else 0)]
    return (len(places), places[0], data.count(b"\n", 0, places[0]) + 1) if places else (0, None, None)


def physical_lines(text: str) -> list[str]:
    """Lines with their ends; CRLF, CR and LF end a line, nothing else does."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", text)


def sniff(text: str, kind: str | None = None) -> str:
    """The delimiter under which most of the first lines have as many fields as the header, two at least; more fields
    are better, then the kind's usual one, then the order of preference."""
    lines = [x for x in text.splitlines() if x.strip()][:SNIFFED_LINES]

    def score(d: str) -> tuple[int, int, bool, int]:
        counts = [len(r) for r in csv.reader(lines, delimiter=d)]
        width = counts[0] if counts and counts[0] > 1 else 0
        return (counts.count(width) if width else 0, width, d == USUAL.get(kind), -DELIMITERS.index(d))

    best = max(DELIMITERS, key=score)
    return best if score(best)[1] else USUAL.get(kind, DELIMITERS[0])


def read_rows(text: str, delimiter: str) -> Iterator[tuple[int, list[str], int, str | None]]:
    """(first line, fields, lines, error): quotes are doubled inside quotes, and a row that cannot be read is a row."""
    used = 0

    def feed() -> Iterator[str]:
        nonlocal used
        for line in physical_lines(text):
            used += 1
            yield line

    reader, start = csv.reader(feed(), delimiter=delimiter, doublequote=True, strict=True), 1
    while True:
        fields, error = [], None
        try:
            fields = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            error = str(e)
        end = max(used, start)
        yield start, fields, end - start + 1, error
        start = end + 1


def classify_header(header: list[str], vocabularies: dict[str, list[tuple[str, list[str]]]]) -> dict:
    """kind, vocabulary, ok, missing, extra, duplicated of a header against {kind: [(name, columns)]}.

    Names are compared trimmed and case folded. The best share of expected names wins, the first of equals; below
    KNOWN_SHARE the kind is unknown.
    """
    seen = [h.strip().casefold() for h in header]
    best: tuple[float, str, str, list[str]] = (0.0, "unknown", "", [])
    for kind in KINDS:
        for name, columns in vocabularies.get(kind, ()):
            wanted = [c.strip().casefold() for c in columns]
            found = len(set(wanted) & set(seen)) / len(wanted)
            if found > best[0]:
                best = (found, kind, name, columns)
    if best[0] < KNOWN_SHARE:
        best = (best[0], "unknown", "", [])
    wanted = {c.strip().casefold(): c for c in best[3]}
    known = best[1] != "unknown"
    duplicated = sorted({h for h, s in zip(header, seen, strict=True) if seen.count(s) > 1})
    return {
        "kind": best[1], "vocabulary": best[2] or None, "duplicated": duplicated, "ok": known and seen == list(wanted) and not duplicated,
        "missing": [c for s, c in wanted.items() if s not in seen], "extra": [h for h, s in zip(header, seen, strict=True) if s not in wanted] if known else [],
    }


def column_index(header: list[str], name: str) -> int | None:
    names = [h.strip().casefold() for h in header]
    return names.index(name.strip().casefold()) if name.strip().casefold() in names else None


def describe(text: str, vocabularies: dict, keys: dict[str, str], overrides: dict) -> dict:
    """Dialect, header and kind of a file from its first lines, and the line of its header."""
    delimiter = overrides.get("delimiter") or sniff(text, overrides.get("kind"))
    line, header = next(((line, fields) for line, fields, _, error in read_rows(text, delimiter) if not error), (None, []))
    found = classify_header(header, vocabularies)
    if overrides.get("kind"):
        found["kind"] = overrides["kind"]
    if not overrides.get("delimiter") and not overrides.get("kind") and found["kind"] != "unknown":
        delimiter = sniff(text, found["kind"])
    names = [keys[k] for k in (f"{found['kind']}:{found['vocabulary']}", found["kind"]) if k in keys]
    return {"delimiter": delimiter, "header": header, "header_line": line, "header_ok": found.pop("ok"), **found, "key_index": (column_index(header, names[0]) if names else None) or 0}


def _opened(data: bytes, vocabularies: dict, keys: dict[str, str], overrides: dict) -> dict:
    text, encoding, refused = decode(data, overrides.get("encoding"))
    if refused:
        return {"refused": refused[0], "refused_detail": refused[1]}
    many, first, line = utf8_sequences(data) if encoding == "cp1252" else (0, None, None)
    found = describe(text, vocabularies, keys, overrides)
    return {"text": text, "encoding": encoding, "had_mark": data.startswith(UTF8_MARK), **found, "utf8_sequences": many, "first_utf8_offset": first, "first_utf8_line": line}


def analyse_files(files: DataFrame, vocabularies: dict, keys: dict[str, str], overrides: dict[str, dict] | None = None) -> DataFrame:
    """One row per file of ``files(path, content)``: encoding, dialect, header, and why it is refused if it is."""
    names = [f.split()[0] for f in FILES.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [{"path": p, **_opened(c, vocabularies, keys, (overrides or {}).get(p, {}))} for p, c in zip(batch.path, batch.content, strict=True)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names).astype({n: "Int64" for n in names if n in ("key_index", "utf8_sequences", "first_utf8_offset", "first_utf8_line")})

    return files.mapInPandas(work, FILES)


def raw_rows(files: DataFrame, vocabularies: dict, keys: dict[str, str], overrides: dict[str, dict] | None = None, chunk: int = 10_000) -> DataFrame:
    """The rows below the header of every file that is not refused, as they stand."""
    names = [f.split()[0] for f in ROWS.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch.path, batch.content, strict=True):
                one = _opened(c, vocabularies, keys, (overrides or {}).get(p, {}))
                if "refused" in one:
                    continue
                held, past_header = [], False
                for line, fields, span, error in read_rows(one["text"], one["delimiter"]):
                    if not past_header:
                        past_header = error is None
                        continue
                    held.append((p, one["kind"], one["delimiter"], line, fields, span, error))
                    if len(held) >= chunk:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return files.mapInPandas(work, ROWS)


#: Lines of a file that one task orders.
BLOCK_LINES = 10_000


def _islands(rows: DataFrame) -> DataFrame:
    """``rows(path, line_no, starts, broken, ...)`` with head: line_no and broken of the last row that starts at or before
    each, null before the first. Blocks of lines are ordered apart; the last start of each is carried over the small table
    of blocks."""
    start = F.when(F.col("starts"), F.struct("line_no", "broken"))
    blocks = rows.withColumn("block", F.expr(f"line_no div {BLOCK_LINES}"))
    inside = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy("path", "block").agg(F.max(start).alias("own")).withColumn("carried", F.last("own", ignorenulls=True).over(before)).drop("own")
    found = blocks.withColumn("own", F.last(start, ignorenulls=True).over(inside)).join(carried, ["path", "block"])
    return found.withColumn("head", F.coalesce("own", "carried")).drop("own", "carried", "block")


def recovered_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Logical rows: path, kind, line_no, fields, key, outcome (ok, recovered, rejected), code and detail of its finding.

    Wholly blank rows are dropped with a finding of their own. In text files a row without a key continues the one before
    it; in other files it makes the whole row rejected. A row that cannot be parsed belongs to no row and ends the one
    before it. The row that each line belongs to is found inside blocks of lines, so that a long file is the work of many tasks.
    """
    f = files.select("path", "key_index", F.size("header").alias("expected"))
    blank = F.forall("fields", lambda x: F.trim(x) == "")
    r = rows.join(F.broadcast(f), "path")  # a shuffle by path would give each file to one task
    dropped = r.where(F.col("error").isNull() & blank)
    kept = r.where(~(F.col("error").isNull() & blank))
    own_key = F.get("fields", F.col("key_index"))
    anchored = F.coalesce(own_key.rlike(KEY), F.lit(False)) | (F.col("kind") == "unknown")
    broken = F.col("error").isNotNull()
    marked = _islands(kept.withColumns({"starts": anchored | broken, "broken": broken}))
    # A continuation after a broken row, or before any row, has nothing to continue: it is an island of its own.
    lost = ~F.col("starts") & (F.col("head").isNull() | F.col("head.broken"))
    marked = marked.withColumn("island", F.coalesce("head.line_no", F.lit(0)))
    marked = marked.withColumn("lost", lost).withColumn("part", F.when(F.col("lost"), F.col("line_no")).otherwise(F.lit(0)))
    grouped = marked.groupBy("path", "kind", "delimiter", "key_index", "expected", "island", "part").agg(F.sort_array(F.collect_list(F.when((F.col("kind") == "text") | F.col("starts") | F.col("lost"), F.struct("line_no", "fields", "line_span", "error")))).alias("rows"), F.max("lost").alias("lost"), F.max("broken").alias("broken"), (F.count("*") - 1).alias("more"), F.sum("line_span").cast("int").alias("span"))
    # A text row takes its continuations onto its last field, and fields beyond two are parts of the narrative; of other
    # kinds the first line alone is held, however many follow.
    is_text = F.col("kind") == "text"
    g = grouped.withColumns({"line_no": F.col("rows")[0]["line_no"], "error": F.col("rows")[0]["error"], "own": F.col("rows")[0]["fields"]})
    glued = F.expr("concat(slice(own, 1, size(own) - 1), array(concat(element_at(own, -1), array_join(transform(slice(rows, 2, greatest(size(rows) - 1, 0)), x -> concat('\n', array_join(x.fields, delimiter))), ''))))")
    g = g.withColumn("joined", F.when(is_text & (F.col("more") > 0) & ~F.col("lost"), glued).otherwise(F.col("own")))
    g = g.withColumn("collapsed", is_text & (F.size("joined") > 2) & ~F.col("lost"))
    g = g.withColumn("fields", F.when(F.col("collapsed"), F.expr("array(joined[0], array_join(slice(joined, 2, size(joined)), delimiter))")).otherwise(F.col("joined")))
    key = F.get("fields", F.col("key_index"))
    g = g.withColumn("key", F.when(key.rlike(KEY) & ~F.col("broken") & ~F.col("lost"), key))
    wrong_count = (F.col("expected") > 0) & (F.size("fields") != F.col("expected"))
    split = ~is_text & (F.col("more") > 0)
    code = F.when(F.col("broken") | F.col("lost"), "ROW_REJECTED_PARSE_ERROR").when(split | wrong_count, "ROW_REJECTED_FIELD_COUNT").when((F.col("more") > 0) | (F.col("span") > 1) | F.col("collapsed"), "ROW_RECOVERED")
    method = F.when(F.col("more") > 0, "key_anchor").when(F.col("span") > 1, "quoted").otherwise("delimiter_in_narrative")
    text = lambda c: c.cast("string")
    detail = (
        F.when(F.col("lost"), F.create_map(F.lit("error"), F.lit("continuation line with no preceding record")))
        .when(F.col("broken"), F.create_map(F.lit("error"), F.col("error"), F.lit("lines"), text(F.col("span"))))
        .when(code == "ROW_RECOVERED", F.create_map(F.lit("method"), method, F.lit("continuation_lines"), text(F.greatest(F.col("span") - 1, F.lit(0)))))
        .when(code.isNotNull(), F.create_map(F.lit("expected_fields"), text(F.col("expected")), F.lit("actual_fields"), text(F.size("fields")), F.lit("reason"), F.when(split, "continuation_line").otherwise("field_count")))
    )
    outcome = F.when(code.isNull(), "ok").when(code == "ROW_RECOVERED", "recovered").otherwise("rejected")
    out = g.select("path", "kind", "line_no", "fields", "key", outcome.alias("outcome"), code.alias("code"), detail.alias("detail"))
    gone = dropped.select("path", "kind", "line_no", "fields", F.lit(None).cast("string").alias("key"), F.lit("dropped").alias("outcome"), F.lit("ROW_BLANK_DROPPED").alias("code"), F.create_map(F.lit("line_no"), text(F.col("line_no"))).alias("detail"))
    return out.union(gone)


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per file the most frequent trimmed non-blank value, of equals the smallest."""
    v = F.trim(value)
    counted = rows.where(v != "").groupBy(by, v.alias("value")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def file_findings(files: DataFrame) -> DataFrame:
    """path, code, detail of what ``analyse_files`` saw."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cases = {
        "refused": (F.col("refused").isNotNull(), F.col("refused"), F.create_map(F.lit("detail"), text("refused_detail"))),
        "mojibake": (F.col("utf8_sequences") > 0, F.lit("UTF8_READ_AS_CP1252"), F.create_map(F.lit("count"), text("utf8_sequences"), F.lit("first_offset"), text("first_utf8_offset"), F.lit("first_line"), text("first_utf8_line"))),
        "unknown": (F.col("kind") == "unknown", F.lit("UNKNOWN_HEADER"), F.create_map(F.lit("header"), F.array_join("header", "|"))),
        "header": ((F.col("kind") != "unknown") & ~F.col("header_ok"), F.lit("HEADER_MISMATCH"), F.create_map(F.lit("missing"), F.array_join("missing", "|"), F.lit("extra"), F.array_join("extra", "|"), F.lit("duplicated"), F.array_join("duplicated", "|"))),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(code.alias("code"), detail.alias("detail"))) for test, code, detail in cases.values())), lambda x: x.isNotNull())
    return files.select("path", F.explode(found).alias("x")).select("path", "x.code", "x.detail")


def preview(files: DataFrame, lines: int, scrub=None) -> DataFrame:
    """The first lines of each file, each scrubbed; a file that cannot be read, or a scrub that fails, shows none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, c in zip(batch.path, batch.content, strict=True):
                text = decode(c)[0]
                try:
                    shown = [scrub(x.rstrip("\r\n")) if scrub else x.rstrip("\r\n") for x in physical_lines(text or "")[:lines]]
                except TimeoutError:
                    shown = []
                out.append((p, shown))
            yield pd.DataFrame(out, columns=["path", "lines"])

    return files.mapInPandas(work, "path string, lines array<string>")


def override_findings(detected: DataFrame, effective: DataFrame) -> DataFrame:
    """path, setting, detected, effective of each encoding, delimiter or kind that an analyst changed."""
    names = ["encoding", "delimiter", "kind"]
    long = lambda df, value: df.unpivot("path", names, "setting", value)
    both = long(detected, "detected").join(long(effective, "effective"), ["path", "setting"])
    return both.where(~F.col("detected").eqNullSafe(F.col("effective")))
