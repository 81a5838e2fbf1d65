"""A corpus pipeline: language ID, quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents`` (doc_id, text, lang, source, n_chars, and any that were added to the table). Nulls, empty and very long
texts, repeated rows and empty tables pass through the stages as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import quality_rules as rules
from gleanworks.llm.language_id import predict_language
from gleanworks.llm.near_dedup import near_duplicates
from gleanworks.llm.packing import pack
from gleanworks.llm.secret_scan import redacted, scan


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no text, no letter, or a narrow margin) go."""
    return predict_language(docs, docs).where("NOT rejected").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a rule of the threshold table go."""
    found = rules.measure(docs.select(F.struct("*").alias("row"), "text"))
    return found.where(rules.verdict(F.col("_m"))[1]).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the text with the smallest doc_id stays; of repeated rows one.

    Documents with a null doc_id stay, as they take no part in linking. Texts that share a doc_id are judged apart, each in
    the group that it is linked with; of two such texts in one group one stays.
    """
    stays = near_duplicates(docs.select("doc_id", "text")).where("stays AND doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), F.col("text_id").alias("t")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    kept = rows.where("d IS NOT NULL").join(stays, ["d", "t"], "left_semi").dropDuplicates(["d", "t"])
    return kept.unionByName(rows.where("d IS NULL")).select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values judged secrets are masked in the text; n_chars follows the new text where there is one."""
    found = scan(docs.select(F.struct("*").alias("row"), "text"), into="findings")
    masked = F.col("row").withField("text", redacted(F.col("text"), F.col("findings")))
    if "n_chars" in docs.columns:
        masked = masked.withField("n_chars", F.length(masked["text"]).cast(docs.schema["n_chars"].dataType))
    changed = F.size(F.filter("findings", lambda c: c["secret"])) > 0
    return found.select(F.when(changed, masked).otherwise(F.col("row")).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]
#: SQL cannot express trained dictionaries, forests and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
