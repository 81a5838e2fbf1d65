"""Deliveries and exports as formats of Spark: ``spark.read.format("gleanworks_delivery")``, and ``gleanworks_export`` both ways.

``register(spark)`` makes them known. Files are opened by tasks through pyarrow's file systems, so a path is a URI that
executors can open (file, HDFS, S3, GCS) or a local path. A predicate on the kind of file is decided from the head of each
file when partitions are planned, so that files of other kinds are never read.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from .delivery import ROWS, UTF8_MARK, _opened, decode, describe, read_rows
from .exports import HEADERS

HEAD_BYTES, BATCH = 1 << 16, 10_000
MARK = "﻿"


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str, list[pyarrow.fs.FileInfo]]:
    """The file system of a path, the path in it, and its files in order of name; hidden ones and those below hidden folders
    are no data."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)
    info = fs.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        return fs, path, [info]
    below = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if info.type == pyarrow.fs.FileType.Directory else []
    seen = lambda p: not any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
    return fs, path, sorted((f for f in below if f.type == pyarrow.fs.FileType.File and seen(f.path)), key=lambda f: f.path)


@dataclass
class FilePart(InputPartition):
    uri: str
    path: str
    first: bool = False


class _KindFilter:
    """Values of ``kind`` that predicates leave; other predicates are Spark's."""

    kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("kind",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = values if self.kinds is None else self.kinds & values
            yield f  # rows are still compared: a file is of one kind, so this costs little


class DeliveryReader(_KindFilter, DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.vocabularies = json.loads(options.get("vocabularies", "{}"))
        self.keys = json.loads(options.get("keys", "{}"))

    def _kind(self, fs: pyarrow.fs.FileSystem, path: str) -> str | None:
        """The kind of a file from its first lines; None where the head is too short to tell."""
        with fs.open_input_stream(path) as f:
            head = f.read(HEAD_BYTES)
        whole = len(head) < HEAD_BYTES
        text = decode(head if whole else head[: head.rfind(b"\n") + 1])[0]
        if not text:
            return "unknown" if whole else None
        found = describe(text, self.vocabularies, self.keys, {})
        return found["kind"] if found["header"] or whole else None

    def partitions(self) -> Sequence[InputPartition]:
        fs, _, files = _files(self.uri)
        wanted = files if self.kinds is None else [f for f in files if (kind := self._kind(fs, f.path)) is None or kind in self.kinds]
        return [FilePart(self.uri, f.path) for f in wanted] or [FilePart(self.uri, "")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _, _ = _files(self.uri)
        with fs.open_input_stream(partition.path) as f:
            one = _opened(f.read(), self.vocabularies, self.keys, {})
        if "refused" in one:
            return
        held: list[tuple] = []
        for line, fields, span, error in read_rows(one["text"], one["delimiter"]):
            if one["header_line"] and line > one["header_line"]:
                held.append((partition.path, one["kind"], one["delimiter"], line, fields, span, error))
            if len(held) >= BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in ROWS.split(", ")])


class DeliverySource(DataSource):
    """Rows below the header of every delivered file that is not refused, as of ``delivery.raw_rows``; options path,
    vocabularies and keys (JSON). A task reads a file; long ones are the work of ``ranges.Delivery``."""

    @classmethod
    def name(cls) -> str:
        return "gleanworks_delivery"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return DeliveryReader(self.options)


class ExportReader(_KindFilter, DataSourceReader):
    """Exports below a path: rows of one kind as its columns, or of all kinds as kind and a map."""

    def __init__(self, options: dict):
        self.uri, self.kind = options["path"], options.get("kind")

    @staticmethod
    def _head(fs: pyarrow.fs.FileSystem, path: str) -> str | None:
        """The kind of export that begins with this file, if one does."""
        with fs.open_input_stream(path) as f:
            head = f.read(HEAD_BYTES)
        if not head.startswith(UTF8_MARK):
            return None
        lines = head.decode("utf-8-sig", "replace").split("\r\n")
        names = next(csv.reader([lines[2]], delimiter=";"), []) if len(lines) > 2 else []
        return next((k for k, columns in HEADERS.items() if columns == names), None)

    def partitions(self) -> Sequence[InputPartition]:
        """Parts in order; a part without a head belongs to the export whose head comes before it in its folder."""
        fs, _, files = _files(self.uri)
        parts, kind, folder = [], None, None
        for f in files:
            head = self._head(fs, f.path)
            if head or f.path.rpartition("/")[0] != folder:
                kind, folder = head, f.path.rpartition("/")[0]
            if kind and self.kind in (None, kind) and (self.kinds is None or kind in self.kinds):
                parts.append(FilePart(kind, f.path, bool(head)))
        return parts or [FilePart("", "")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _, _ = _files(self.uri)
        columns = HEADERS[partition.uri]
        with fs.open_input_stream(partition.path) as f:
            text = io.TextIOWrapper(f, encoding="utf-8-sig" if partition.first else "utf-8", newline="")
            for _ in range(2 if partition.first else 0):
                text.readline()
            rows = csv.reader(text, delimiter=";", strict=True)
            if partition.first:
                next(rows)
            held: list[list[str]] = []
            for row in rows:
                held.append(row)
                if len(held) >= BATCH:
                    yield self._batch(partition.uri, columns, held)
                    held = []
            if held:
                yield self._batch(partition.uri, columns, held)

    def _batch(self, kind: str, columns: list[str], rows: list[list[str]]) -> pa.RecordBatch:
        if self.kind:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=columns)
        values = pa.array([list(zip(columns, r, strict=True)) for r in rows], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), values], names=["kind", "values"])


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class ExportWriter(DataSourceArrowWriter):
    """Parts are written beside the export and become it when all tasks have ended; nothing is left of a job that fails."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.uri, self.kind, self.overwrite = options["path"].rstrip("/"), options["kind"], overwrite
        columns = HEADERS[self.kind]
        if [f.name for f in schema.fields] != columns:
            raise ValueError(f"an export of {self.kind} has the columns {', '.join(columns)}")
        self.head = [" ".join(options.get(o, d).splitlines()) for o, d in (("classification", "internal"), ("context", ""))]
        self.job = f"_writing-{uuid.uuid4().hex}"

    def _at(self) -> tuple[pyarrow.fs.FileSystem, str]:
        fs, path, _ = _files(self.uri)
        return fs, path

    @staticmethod
    def _text(value: object) -> str:
        return "" if value is None else str(value)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, path = self._at()
        partition = TaskContext.get().partitionId()
        fs.create_dir(f"{path}/{self.job}", recursive=True)
        name = f"{path}/{self.job}/part-{partition:06d}-{uuid.uuid4().hex}.csv"
        with fs.open_output_stream(name) as f:
            for batch in iterator:
                text = io.StringIO()
                lines = csv.writer(text, delimiter=";", lineterminator="\r\n")
                lines.writerows([self._text(v) for v in row] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
                f.write(text.getvalue().encode())
        return Part(partition, name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = self._at()
        old = [f.path for f in _files(self.uri)[2]] if self.overwrite else []
        if not self.overwrite and _files(self.uri)[2]:
            self.abort(messages)
            raise FileExistsError(f"{self.uri} holds an export already")
        fs.create_dir(path, recursive=True)
        for p in old:
            fs.delete_file(p)
        columns = io.StringIO()
        csv.writer(columns, delimiter=";", lineterminator="").writerow(HEADERS[self.kind])
        with fs.open_output_stream(f"{path}/part-000000-head.csv") as f:
            f.write(f"{MARK}# {self.head[0]}\r\n# {self.head[1]}\r\n{columns.getvalue()}\r\n".encode())
        for k, part in enumerate(sorted((m for m in messages if m), key=lambda m: m.partition), 1):
            fs.move(part.path, f"{path}/part-{k:06d}.csv")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = self._at()
        if fs.get_file_info(f"{path}/{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.job}")


class ExportSource(DataSource):
    """One of HEADERS (option kind) as a folder of parts that, one after another, are the file: byte order mark, the two
    comments (options classification, context), names, rows. Read without a kind: kind and values of every export below."""

    @classmethod
    def name(cls) -> str:
        return "gleanworks_export"

    def schema(self) -> StructType | str:
        kind = self.options.get("kind")
        return StructType([StructField(c, StringType()) for c in HEADERS[kind]]) if kind else "kind string, values map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExportReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ExportWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let it hand them predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DeliverySource, ExportSource):
        spark.dataSource.register(source)
