"""CSV exports: byte order mark, semicolons, CRLF, two comment lines, then a fixed header.

Executors write the rows as parts of a folder in their order; the mark, the comments and the header are its first part, so
that the parts one after another are the file. ``gather`` joins them where a person wants one file.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each export.
HEADERS = {
    "census": ["table_name", "column_name", "type_hint", "record_count", "populated_count", "populated_rate", "distinct_count", "top_value_share", "long_tail", "top_values", "withheld"],
    "findings": ["code", "severity", "key", "line_no", "detail"],
    "presence": ["record_id", "anonymised", "record_value", "finding", "language", "language_confidence"],
    "mismatches": ["mismatch_id", "record_id", "anonymised", "feature_key", "record_value", "extracted_value", "evidence_span", "analyst_tag", "tagged_at", "note", "unfall_uid", "record_label", "extracted_label", "record_label_state", "extracted_label_state"],
    "run_scores": ["feature_key", "language", "metric", "value", "n", "ci_low", "ci_high"],
    "run_mismatches": ["mismatch_id", "record_id", "feature_key", "record_value", "extracted_value", "evidence_span", "analyst_tag", "tagged_at", "note"],
}


def detail_text(column: str = "detail"):
    """A map as k=v pairs in key order, joined by bars."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")


def values_text(column: str = "top_values"):
    """Top values as value:count pairs, joined by bars."""
    return F.array_join(F.transform(column, lambda v: F.concat(v["value_raw"], F.lit(":"), v["n"].cast("string"))), "|")


def csv_line(columns: list[Column]) -> Column:
    """The values as a line: nulls empty, and quoted where a value holds a semicolon, a quotation mark or a line end."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    quoted = lambda c: F.when(c.rlike("[;\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(";", *(quoted(text(c)) for c in columns))


def write_csv(rows: DataFrame, path: str, classification: str, context: str, columns: list[str] | None = None) -> None:
    """Write rows in their order as the folder ``path``."""
    columns = columns or rows.columns
    named = io.StringIO()
    csv.writer(named, delimiter=";", lineterminator="").writerow(columns)
    classification, context = (" ".join(x.splitlines()) for x in (classification, context))
    head = f"\ufeff# {classification}\r\n# {context}\r\n{named.getvalue()}"
    first = rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    flat = [F.when(F.col(c), "True").otherwise("False") if rows.schema[c].dataType.typeName() == "boolean" else F.col(c) for c in columns]
    first.union(rows.select(csv_line(flat).alias("value"))).write.option("lineSep", "\r\n").text(path)


def gather(spark: SparkSession, path: str, out: str) -> None:
    """Join the parts of the folder ``path`` to the file ``out``, as bytes, a block at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, out))
    fs = source.getFileSystem(conf)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    stream = target.getFileSystem(conf).create(target, True)
    for part in parts:
        opened = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, stream, 1 << 16, False)
        opened.close()
    stream.close()


def read_csv(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The rows of one export, a folder or a file, as strings. The first three rows of its first file are its head: the two
    comments and the column names are left out; rows that look like them elsewhere are rows."""
    columns = HEADERS[kind]
    lines = spark.read.option("sep", ";").option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\0")
    rows = lines.schema(", ".join(f"`{c}` string" for c in columns)).csv(path).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).alias("_at"))
    head = rows.agg(F.min("_at").alias("_head"))  # one row
    below = rows.join(F.broadcast(head)).where("_at.file <> _head.file OR _at.at > _head.at + 2")
    return below.select(columns).fillna("")  # an export knows no nulls


def export(kind: str, rows: DataFrame, path: str, classification: str = "internal", context: str = "") -> None:
    """One of HEADERS from a table that has its columns; census values and finding details may still be nested."""
    for name, text in (("top_values", values_text), ("detail", detail_text)):
        if name in rows.columns and rows.schema[name].dataType.typeName() in ("array", "map"):
            rows = rows.withColumn(name, text(name))
    write_csv(rows, path, classification, context, HEADERS[kind])
