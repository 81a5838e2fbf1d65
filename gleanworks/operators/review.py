"""Review of disagreements: lists, tallies, tags that outlive re-scoring, spans, and discarding a run.

Reviews are an append-only log apart from the mismatches, which are recomputed: joining the newest review of each
mismatch on reading keeps tags without an update in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["run_id", "record_id", "feature_id"]
#: Tags a reviewer can give.
TAGS = ("hallucination", "structured_data_error", "unclear")
SORTS = {"record": "record_id", "feature": "feature_id", "tag": "tag", "language": "language"}


def latest(log: DataFrame, keys: list[str], value: list[str], at: str) -> DataFrame:
    """The newest row per key of an append-only log; of equal times the largest row."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(at, *value)).alias("_v"))
    return newest.select(*keys, *(F.col("_v")[v].alias(v) for v in value))


def with_reviews(mismatches: DataFrame, log: DataFrame) -> DataFrame:
    """Mismatches with tag, note and reviewer of their newest review; a cleared review has none."""
    return mismatches.join(latest(log, KEY, ["tag", "note", "reviewer"], "reviewed_at"), KEY, "left")


def set_tag(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with reviews appended; a null tag clears note and reviewer as well."""
    cleared = F.col("tag").isNull()
    return log.unionByName(changes.withColumns({"note": F.when(~cleared, F.col("note")), "reviewer": F.when(~cleared, F.col("reviewer"))}))


def mismatch_list(rows: DataFrame, feature: str | None = None, tag: str | None = None, state: str = "all", sort: str = "record", descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of reviewed mismatches with ``total``; state is all, tagged or untagged; nulls are first ascending."""
    if feature:
        rows = rows.where(F.col("feature_id") == feature)
    if tag:
        rows = rows.where(F.col("tag") == tag)
    elif state != "all":
        rows = rows.where(F.col("tag").isNotNull() if state == "tagged" else F.col("tag").isNull())
    key = F.col(SORTS.get(sort, "record_id"))
    rows = rows.join(rows.agg(F.count("*").alias("total")))
    return rows.orderBy(key.desc() if descending else key.asc(), *KEY).offset(offset).limit(limit)


def mismatch_tally(rows: DataFrame, by: str = "feature_id") -> DataFrame:
    """Per feature: total, reviewed, untagged, each tag, and other tags."""
    tag = F.col("tag")
    return rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count("tag").alias("reviewed"), F.count_if(tag.isNull()).alias("untagged"), *(F.count_if(tag == t).alias(t) for t in TAGS), F.count_if(tag.isNotNull() & ~tag.isin(*TAGS)).alias("other")
    )


def spans(text: str | None, span: str | None) -> list[dict[str, int]]:
    """Non-overlapping places of a span in the original text; if there is none, with any run of blanks, tabs and line
    ends as good as any other."""
    if not text or not span or not span.strip():
        return []
    found = [m.span() for m in re.finditer(re.escape(span), text)]
    if not found:
        words = re.split(r"[ \t\r\n]+", span.strip(" \t\r\n"))
        found = [m.span() for m in re.finditer(r"[ \t\r\n]+".join(map(re.escape, words)), text)]
    return [{"start": a, "end": b} for a, b in found]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def locate_span(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, span in columns:
        yield pd.Series([spans(t, s) for t, s in zip(text, span, strict=True)])


def mismatch_detail(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with the narrative and the places of their evidence in it."""
    return rows.join(records.select("record_id", "narrative"), "record_id").withColumn("places", locate_span("narrative", "evidence"))


def anonymisation_marking(rows: DataFrame, column: str, delivered: str) -> DataFrame:
    """``rows`` with marking: the text came from the anonymised column, or the delivery says yes, no or nothing."""
    said = F.when(F.col(delivered) == "yes", "anonymised").when(F.col(delivered) == "no", "not_anonymised").otherwise("unknown")
    return rows.withColumn("marking", F.when(F.col(column), "anonymised_column").otherwise(said))


def discard_preview(run: str, extractions: DataFrame, scores: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: what discarding a run would remove."""
    of = lambda df: df.where(F.col("run_id") == run)
    a = of(extractions).agg(F.count("*").alias("records"))
    b = of(scores).agg(F.count("*").alias("scores"))
    c = of(reviewed).agg(F.count("*").alias("mismatches"), F.count("tag").alias("tagged"))
    return a.join(b).join(c)


def run_export(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with feature keys in place of ids."""
    return rows.join(features.select("feature_id", "feature_key"), "feature_id").drop("feature_id")
