"""Long delivered files, each the work of many tasks: byte ranges of one file are read apart and give the rows of the whole.

Spark's text source cuts files into ranges, at line feeds. Where a range begins, the reader of the whole file is either at
the start of a row or inside a quoted field. A first pass finds per range what decides encoding and refusal, and describes
the head of the file; a second one, over files with quotation marks, finds where each of the two states leads through the
range. The states of all ranges then follow one from another, and in the last pass each range parses the rows that begin
in it. A row that goes on in the next range is put together from its pieces; there is at most one for each end of a range.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delivery import _MULTIBYTE, FILES, ROWS, SNIFFED_LINES, UTF8_MARK, WIDE_MARKS, describe, physical_lines

#: The most ranges of a delivery: a row for each comes to the driver. Longer ranges are a setting of the session.
MAX_RANGES = 500_000
#: Lines that describe a file, more where they hold too few that are not blank.
HEAD_LINES = 200
#: Characters of a field beyond which the parser gives up, and so reads on at the next line.
FIELD_LIMIT = csv.field_size_limit()
ENCODINGS = ("utf-8", "cp1252", "latin-1", "iso-8859-1", "ascii")
_UNDEFINED = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]")
SEEN = "path string, start long, size long, n_bytes long, n_lines long, n_feeds long, n_plain long, nul long, utf8 long, cp1252 long, ascii long, bad binary, many long, first long, first_feed long, quotes boolean, mark string, heads string"
LED = "path string, start long, state int, open boolean, first long, first_line long, closing long, left long, long boolean"
PARSED = f"{ROWS}, owner long, piece long, raw binary, first_line long"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, size, line): the bytes between line feeds, in the order of each range."""
    text = spark.read.option("lineSep", "\n").text(path)
    m = "_metadata"
    return text.select(F.col(f"{m}.file_path").alias("path"), F.col(f"{m}.file_block_start").alias("start"), F.col(f"{m}.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def _stretches(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bytes]]:
    """(values of ``keys``, bytes) of runs of lines that share them, line feeds put back."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        lines = batch.column("line").to_pylist()
        at = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or any(c[k] != c[at] for c in columns):
                yield tuple(c[at] for c in columns), b"\n".join(lines[at:k]) + b"\n"
                at = k


def _line_ends(data: bytes) -> int:
    return data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")


# --- what a file is ------------------------------------------------------------------------------------------------


class _Head:
    """The first lines of a file, until they are enough to describe it."""

    def __init__(self) -> None:
        self.lines: list[bytes] = []
        self.n_feeds = self.n_plain = 0

    def add(self, data: bytes) -> None:
        for line in data.splitlines(keepends=True):
            if self.n_feeds >= HEAD_LINES and self.n_plain >= SNIFFED_LINES:
                return
            self.lines.append(line)
            self.n_feeds, self.n_plain = self.n_feeds + line.endswith(b"\n"), self.n_plain + bool(line.strip())

    def described(self, path: str, describe_head: Callable[[str, str], dict]) -> str:
        """JSON of what the file is in each encoding that can be its own."""
        found, head = {}, b"".join(self.lines)
        for encoding in ENCODINGS:
            try:
                found[encoding] = describe_head(path, head.decode(encoding))
            except UnicodeDecodeError:
                continue
        return json.dumps(found)


class _Seen:
    """What decides the encoding, of the bytes of a range as they come."""

    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size
        self.n_bytes = self.n_lines = self.n_feeds = self.n_plain = self.many = 0
        self.nul = self.utf8 = self.cp1252 = self.ascii = self.first = self.first_feed = None
        self.bad: dict[str, int] = {}
        self.quotes, self.mark, self.head = False, None, _Head()

    def add(self, data: bytes) -> None:
        if self.start == 0:
            if not self.n_bytes:
                self.mark = next((name for m, name in WIDE_MARKS if data.startswith(m)), None)
            self.head.add(data)
        if self.nul is None and (at := data.find(0)) >= 0:
            self.nul = self.n_bytes + at
        if not data.isascii():
            if self.utf8 is None:
                try:
                    data.decode()
                except UnicodeDecodeError as e:
                    self._bad("utf8", e.start, data)
            for name, pattern in (("cp1252", _UNDEFINED), ("ascii", _BEYOND_ASCII)):
                if getattr(self, name) is None and (m := pattern.search(data)):
                    self._bad(name, m.start(), data)
            for m in _MULTIBYTE.finditer(data):
                if not self.many:
                    self.first, self.first_feed = self.n_bytes + m.start(), self.n_feeds + data.count(b"\n", 0, m.start())
                self.many += 1
        self.quotes = self.quotes or b'"' in data
        self.n_bytes += len(data)
        self.n_lines += _line_ends(data)
        self.n_feeds += data.count(b"\n")
        self.n_plain += sum(map(bool, map(bytes.strip, data.splitlines()))) if self.n_plain < SNIFFED_LINES else 0

    def _bad(self, name: str, at: int, data: bytes) -> None:
        setattr(self, name, self.n_bytes + at)
        self.bad[name] = data[at]


def _seen(batches: Iterator[pa.RecordBatch], describe_head: Callable[[str, str], dict]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SEEN.split(", ")]

    def row(s: _Seen) -> pa.RecordBatch:
        values = {n: getattr(s, n, None) for n in names} | {"bad": json.dumps(s.bad).encode(), "heads": s.head.described(s.path, describe_head) if s.start == 0 else None}
        kinds = {"path": pa.string(), "quotes": pa.bool_(), "bad": pa.binary(), "mark": pa.string(), "heads": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([values[n]], kinds.get(n, pa.int64())) for n in names], names=names)

    one: _Seen | None = None
    for key, data in _stretches(batches, ["path", "start", "size"]):
        if one is None or (one.path, one.start) != key[:2]:
            if one:
                yield row(one)
            one = _Seen(*key)
        one.add(data)
    if one:
        yield row(one)


def _heads(batches: Iterator[pa.RecordBatch], describe_head: Callable[[str, str], dict]) -> Iterator[pa.RecordBatch]:
    """The same of files whose lines come in order, where the first range holds too few of them."""
    path, head = None, _Head()
    row = lambda: pa.RecordBatch.from_pydict({"path": [path], "heads": [head.described(path, describe_head)]})
    for (p, _), data in _stretches(batches, ["path", "start"]):
        if p != path:
            if path is not None:
                yield row()
            path, head = p, _Head()
        head.add(data)
    if path is not None:
        yield row()


# --- where quoted fields lead --------------------------------------------------------------------------------------


class Quoting:
    """Steps over rows that hold quotation marks, as the strict parser does: bytes in which a field may be open at first."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter.encode())
        field = rb'(?:"[^"]*+(?:""[^"]*+)*+"|[^"' + d + rb"\r\n][^" + d + rb"\r\n]*+|)"
        self.row = re.compile(field + rb"(?:" + d + field + rb")*+(?:\r\n?|\n)")
        self.stop = re.compile(rb"[" + d + rb"\r\n]")
        self.delimiter = delimiter.encode()

    @staticmethod
    def line_end(data: bytes, at: int) -> int:
        """Where the line after the one that holds ``at`` begins."""
        feed, ret = data.find(b"\n", at), data.find(b"\r", at)
        if ret >= 0 and (feed < 0 or ret < feed):
            return ret + 2 if feed == ret + 1 else ret + 1
        return feed + 1

    def _close(self, data: bytes, at: int) -> tuple[int, bool | None]:
        """From inside a quoted field: (where it goes on, True in the same row, False at a new row, None: still open)."""
        while True:
            quote = data.find(b'"', at)
            if quote < 0:
                return len(data), None
            follows = data[quote + 1 : quote + 2]
            if follows == b'"':
                at = quote + 2
            elif follows == self.delimiter:
                return quote + 2, True
            else:  # the end of the row, or text that the parser refuses: it goes on with the next line
                return self.line_end(data, quote + 1), False

    def lead(self, data: bytes, is_open: bool) -> tuple[bool, int, int, int, bool]:
        """Of lines: (whether a field is open at the end, where the first row begins or -1, bytes up to the end of the field
        open at first, bytes of the field open at the end, whether a row of several lines may be too long)."""
        at, first, closing, left, long = 0, -1 if is_open else 0, 0, 0, False
        inside = is_open  # of a row
        began = 0
        while at < len(data):
            if not inside:
                quote = data.find(b'"', at)
                if quote < 0:
                    return False, first, closing, 0, long
                at = max(at, data.rfind(b"\n", at, quote) + 1, data.rfind(b"\r", at, quote) + 1)
                began = at
                m = self.row.match(data, at)
                if m:
                    long = long or m.end() - at > FIELD_LIMIT
                    at = m.end()
                    continue
                inside = True
            elif is_open:
                at, same = self._close(data, at)
                if same is None:
                    return True, first, len(data), len(data), long or len(data) > FIELD_LIMIT
                closing, is_open, inside = at, False, same
                if not inside and first < 0:
                    first = at
                continue
            # a row that is not well formed, from the start of one of its fields
            if data[at : at + 1] == b'"':
                opened = at + 1
                at, same = self._close(data, opened)
                if same is None:
                    return True, first, closing, len(data) - opened, long or len(data) - began > FIELD_LIMIT
                inside = same
            else:
                m = self.stop.search(data, at)
                inside = m[0] == self.delimiter
                at = m.end() if inside else self.line_end(data, m.start())
            if not inside:
                long = long or at - began > FIELD_LIMIT
                first = at if first < 0 else first
        return False, first, closing, 0, long


def _led(batches: Iterator[pa.RecordBatch], delimiters: dict[str, str]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in LED.split(", ")]
    known: dict[str, Quoting] = {}
    at: tuple | None = None
    held: list[dict] = []
    length = lines = 0

    def rows() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for key, data in _stretches(batches, ["path", "start"]):
        if key != at:
            if at:
                yield rows()
            at, length, lines = key, 0, 0
            held = [{"path": key[0], "start": key[1], "state": s, "open": bool(s), "first": -1 if s else 0, "first_line": 0, "closing": 0, "left": 0, "long": False} for s in (0, 1)]
        d = delimiters[key[0]]
        quoting = known.setdefault(d, Quoting(d))
        found = {s: quoting.lead(data, s) for s in {h["open"] for h in held}}
        for h in held:
            was = h["open"]
            h["open"], first, closing, left, long = found[was]
            h["long"] |= long
            if h["first"] < 0:
                h["closing"] += closing
                if first >= 0:
                    h["first"], h["first_line"] = length + first, lines + _line_ends(data[:first])
            # a field that stays open from before these lines goes on; one that they open is new
            h["left"] = (h["left"] + left if was and first < 0 and h["open"] else left) if h["open"] else 0
            h["long"] |= h["left"] > FIELD_LIMIT
        length, lines = length + len(data), lines + _line_ends(data)
    if at:
        yield rows()


# --- rows ----------------------------------------------------------------------------------------------------------


@dataclass
class Range:
    """What the task of a range has to know."""

    path: str
    number: int
    first_line: int
    n_bytes: int
    is_open: bool = False
    owner: int = -1  # the range in which the row begins that is open here at first
    first: int = 0  # where the first row begins, -1: nowhere
    last: bool = False


@dataclass
class File:
    path: str
    found: dict = field(default_factory=dict)
    ranges: list[tuple[int, Range]] = field(default_factory=list)
    serial: bool = False


def _parsed(lines: Iterator[str], delimiter: str, line: int) -> Iterator[tuple[int, list[str], int, str | None, list[str]]]:
    """(first line, fields, lines, error, the lines) of the rows, as ``delivery.read_rows`` gives them."""
    taken: list[str] = []

    def feed() -> Iterator[str]:
        for x in lines:
            taken.append(x)
            yield x

    reader = csv.reader(feed(), delimiter=delimiter, doublequote=True, strict=True)
    while True:
        fields, error = [], None
        taken.clear()
        try:
            fields = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            error = str(e)
        n = max(len(taken), 1)
        yield line, fields, n, error, list(taken)
        line += n


_PARSED_NAMES = [f.split()[0] for f in PARSED.split(", ")]
_PARSED_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_PARSED_KINDS)], names=_PARSED_NAMES)


def _rows_of_range(data: Iterator[bytes], r: Range, found: dict, chunk: int) -> Iterator[pa.RecordBatch]:
    kind, delimiter, encoding = found["kind"], found["delimiter"], found["encoding"]
    piece = lambda owner, raw, line: (r.path, kind, delimiter, None, None, None, None, owner, r.number, raw, line)
    held, line, skip = [], r.first_line, r.first if r.is_open else 0

    def rest() -> Iterator[bytes]:
        """The bytes from the first row on; those before it belong to a row of an earlier range."""
        nonlocal line, skip
        for d in data:
            if skip:
                head = d if skip < 0 else d[:skip]
                held.append(piece(r.owner, head, 0))
                line += _line_ends(head)
                skip = skip if skip < 0 else skip - len(head)
                d = d[len(head) :]
            if d:
                yield d

    stream = rest()
    first = next(stream, None)
    if first is not None:
        lines = (x for d in _chain(first, stream) for x in physical_lines(d.decode(encoding)))
        for at, fields, n, error, raw in _parsed(lines, delimiter, line):
            if error == "unexpected end of data" and not r.last:
                held.append(piece(r.number, "".join(raw).encode(encoding), at))
            else:
                held.append((r.path, kind, delimiter, at, fields, n, error, None, None, None, None))
            if len(held) >= chunk:
                yield _batch(held)
                held.clear()
    if held:
        yield _batch(held)


def _chain(first: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from more


def _rows(batches: Iterator[pa.RecordBatch], ranges: dict[tuple[str, int], Range], files: dict[str, dict], chunk: int) -> Iterator[pa.RecordBatch]:
    stretches = _stretches(batches, ["path", "start"])
    ahead = next(stretches, None)
    while ahead:
        key, n_bytes = ahead[0], 0

        def data(key: tuple = key) -> Iterator[bytes]:
            nonlocal ahead, n_bytes
            while ahead and ahead[0] == key:
                d, ahead = ahead[1], next(stretches, None)
                n_bytes += len(d)
                yield d

        if key in ranges:
            yield from _rows_of_range(data(), ranges[key], files[key[0]], chunk)
        if key not in ranges or n_bytes != ranges[key].n_bytes:
            raise ValueError(f"{key[0]} is cut elsewhere than when it was analysed: keep spark.sql.files.maxPartitionBytes and the cores as they were, or analyse again")


def _whole(batches: Iterator[pa.RecordBatch], files: dict[str, dict], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of files whose lines come in order, all ranges of a file one after another."""
    stretches = ((k[:1], d) for k, d in _stretches(batches, ["path", "start"]))
    ahead = next(stretches, None)
    while ahead:
        key = ahead[0]

        def data(key: tuple = key) -> Iterator[bytes]:
            nonlocal ahead
            while ahead and ahead[0] == key:
                d, ahead = ahead[1], next(stretches, None)
                yield d

        yield from _rows_of_range(data(), Range(key[0], 0, 1, -1, last=True), files[key[0]], chunk)


def _joined(table: pa.Table) -> pa.Table:
    """The row whose pieces lie in several ranges."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["piece"])
    one = pieces[0]
    text = b"".join(p["raw"] for p in pieces).decode(one["encoding"])
    rows = [(one["path"], one["kind"], one["delimiter"], at, fields, n, error, None, None, None, None) for at, fields, n, error, _ in _parsed(iter(physical_lines(text)), one["delimiter"], one["first_line"])]
    return pa.Table.from_batches([_batch(rows)]).select(_PARSED_NAMES[:7])


# --- a delivery ----------------------------------------------------------------------------------------------------


class Delivery:
    """The files under ``path``, a folder, a file or several: what they are, and their rows, with one task for each range.

    Rows, errors, line numbers and findings are those of reading each file whole. A file may be refused; an empty one has no
    rows. A file with a quoted field of several lines beyond FIELD_LIMIT is read by one task, as the parser's recovery
    depends on where it gives up; so is one whose header is not among its first HEAD_LINES lines. Lines end at line feeds
    for the cut: a file with none of them is one range, of at most 2 GB. Rows are read under the settings that cut the files
    when they were analysed; under others reading fails. ``overrides`` may name one of ENCODINGS.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], vocabularies: dict, keys: dict[str, str], overrides: dict[str, dict] | None = None):
        self.spark, self.lines = spark, lines_of(spark, path)
        overrides = overrides or {}
        for o in overrides.values():
            if o.get("encoding") and o["encoding"] not in ENCODINGS:
                raise ValueError(f"files in {o['encoding']} are read whole")
        describe_head = lambda p, text: describe(text, vocabularies, keys, overrides.get(p, {}))
        seen = self.lines.mapInArrow(lambda b: _seen(b, describe_head), SEEN).limit(MAX_RANGES + 1).collect()
        if len(seen) > MAX_RANGES:
            raise ValueError(f"more than {MAX_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
        listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "length").collect()
        self._files = {r.path: File(r.path) for r in listed}
        by_file: dict[str, list] = {}
        for r in sorted(seen, key=lambda r: (r.path, r.start)):
            by_file.setdefault(r.path, []).append(r)
        heads = self._more_heads(by_file, describe_head)
        marks = {r.path: r.length > 0 for r in listed}  # a file with bytes and without lines is a mark alone
        for p, f in self._files.items():
            self._describe(f, by_file.get(p, []), heads.get(p), overrides.get(p, {}), lambda p=p: describe("", vocabularies, keys, overrides.get(p, {})) | {"had_mark": marks[p]})
        self._lead(by_file)

    def _more_heads(self, by_file: dict[str, list], describe_head: Callable[[str, str], dict]) -> dict[str, str]:
        """Descriptions of files whose first range holds too few lines, from as many ranges as it takes."""
        until = {}
        for p, ranges in by_file.items():
            feeds = plain = 0
            for k, r in enumerate(ranges):
                feeds, plain = feeds + r.n_feeds, plain + r.n_plain
                if feeds >= HEAD_LINES and plain >= SNIFFED_LINES or k + 1 == len(ranges):
                    until |= {(p, x.start): None for x in ranges[: k + 1]} if k else {}
                    break
        if not until:
            return {}
        wanted = self.spark.createDataFrame(list(until), "path string, start long")
        lines = self._of({p for p, _ in until}).withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(wanted), ["path", "start"])
        ordered = lines.repartition("path").sortWithinPartitions("path", "start", "at").select("path", "start", "line")
        return {r.path: r.heads for r in ordered.mapInArrow(lambda b: _heads(b, describe_head), "path string, heads string").collect()}

    def _describe(self, f: File, ranges: list, heads: str | None, override: dict, empty: Callable[[], dict]) -> None:
        if not ranges:
            f.found = empty() | {"encoding": override.get("encoding") or "utf-8", "utf8_sequences": 0, "header_line": None}
            return
        marked = 3 if ranges[0].size - sum(r.n_bytes for r in ranges) >= 2 else 0
        bases, lines, feeds = [], [], []
        at, line, feed = marked, 1, 1
        for r in ranges:
            bases.append(at), lines.append(line), feeds.append(feed)
            at, line, feed = at + r.n_bytes, line + r.n_lines, feed + r.n_feeds
        least = lambda name: next(((b + r[name], json.loads(r.bad).get(name)) for b, r in zip(bases, ranges, strict=True) if r[name] is not None), None)
        if ranges[0].mark and not marked:
            f.found = {"refused": "FILE_UNSUPPORTED_BOM", "refused_detail": ranges[0].mark}
            return
        if nul := least("nul"):
            f.found = {"refused": "FILE_CONTAINS_NUL", "refused_detail": str(nul[0])}
            return
        bad = None
        for encoding in [override["encoding"]] if override.get("encoding") else ["utf-8", "cp1252"]:
            bad = least({"utf-8": "utf8", "latin-1": "none", "iso-8859-1": "none"}.get(encoding, encoding)) if "8859" not in encoding and encoding != "latin-1" else None
            if bad is None:
                break
        else:
            f.found = {"refused": "FILE_UNDECODABLE", "refused_detail": f"{bad[0]}:0x{bad[1]:02x}"}
            return
        f.found = json.loads(heads or ranges[0].heads)[encoding] | {"encoding": encoding, "had_mark": bool(marked), "utf8_sequences": 0}
        if encoding == "cp1252" and (many := sum(r.many for r in ranges)):
            first = next((b + r.first, n + r.first_feed) for b, n, r in zip(bases, feeds, ranges, strict=True) if r.many)
            f.found |= {"utf8_sequences": many, "first_utf8_offset": first[0], "first_utf8_line": first[1]}
        f.serial = f.found["header_line"] is None and sum(r.n_feeds for r in ranges) > HEAD_LINES
        f.ranges = [(r.start, Range(f.path, k, n, r.n_bytes, last=k + 1 == len(ranges))) for k, (r, n) in enumerate(zip(ranges, lines, strict=True))]

    def _lead(self, by_file: dict[str, list]) -> None:
        """The state at the start of each range, from the ranges before it."""
        quoted = {p: f.found["delimiter"] for p, f in self._files.items() if len(f.ranges) > 1 and any(r.quotes for r in by_file[p])}
        if not quoted:
            return
        led = {(r.path, r.start, r.state): r for r in self._of(quoted).mapInArrow(lambda b: _led(b, quoted), LED).collect()}
        for p in quoted:
            f, is_open, owner, left = self._files[p], False, -1, 0
            for start, r in f.ranges:
                found = led[p, start, int(is_open)]
                r.is_open, r.owner, r.first = is_open, owner, found.first
                f.serial = f.serial or found.long or is_open and left + found.closing > FIELD_LIMIT
                if found.open:
                    owner = owner if is_open and found.first < 0 else r.number
                    left = left + found.left if is_open and found.first < 0 else found.left
                is_open = found.open

    def _of(self, paths: Iterable[str]) -> DataFrame:
        return self.lines.select("path", "start", "line").where(F.col("path").isin(list(paths)))

    @property
    def files(self) -> DataFrame:
        """A row for each file, as of ``delivery.analyse_files``."""
        names = [f.split()[0] for f in FILES.split(", ")]
        rows = [tuple(({"path": p} | f.found).get(n) for n in names) for p, f in self._files.items()]
        return self.spark.createDataFrame(rows, FILES)

    def rows(self, chunk: int = 10_000) -> DataFrame:
        """The rows below the header of every file that is not refused, as of ``delivery.raw_rows``."""
        files = {p: f.found for p, f in self._files.items() if "refused" not in f.found and (f.found["header_line"] or f.serial)}
        ranges = {(p, start): r for p in files if not self._files[p].serial for start, r in self._files[p].ranges}
        serial = {p: files[p] for p in files if self._files[p].serial}
        columns = _PARSED_NAMES[:7]
        parsed = self._of({p for p, _ in ranges}).mapInArrow(lambda b: _rows(b, ranges, files, chunk), PARSED)
        encodings = {p: f["encoding"] for p, f in files.items()}
        pieces = parsed.where("owner IS NOT NULL").mapInArrow(lambda b: _named(b, encodings), f"{PARSED}, encoding string")
        out = parsed.where("owner IS NULL").select(columns).unionByName(pieces.groupBy("path", "owner").applyInArrow(_joined, ROWS))
        if serial:
            ordered = self._of(serial).withColumn("at", F.monotonically_increasing_id()).repartition("path").sortWithinPartitions("path", "start", "at").drop("at")
            out = out.unionByName(ordered.mapInArrow(lambda b: _whole(b, serial, chunk), PARSED).select(columns))
        return self._below_header(out, files)

    def _below_header(self, rows: DataFrame, files: dict[str, dict]) -> DataFrame:
        known = {p: f["header_line"] for p, f in files.items() if f["header_line"]}
        lines = self.spark.createDataFrame(list(known.items()), "path string, header_line int")
        below = rows.join(F.broadcast(lines), "path").where("line_no > header_line").drop("header_line")  # at most MAX_RANGES rows
        late = [p for p in files if p not in known]
        if late:
            firsts = rows.where(F.col("path").isin(late) & F.col("error").isNull()).groupBy("path").agg(F.min("line_no").alias("header_line"))
            below = below.unionByName(rows.join(firsts, "path").where("line_no > header_line").drop("header_line"))
        return below.select([f.split()[0] for f in ROWS.split(", ")])


def _named(batches: Iterator[pa.RecordBatch], encodings: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encodings[p] for p in b.column("path").to_pylist()], pa.string())], names=[*b.schema.names, "encoding"])
