"""The registered queries of the operators: each applies its operator to a whole table and keeps the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit as audit
from . import importance_resampling as resampling
from . import quality_rules as rules
from .common import Scratch, table
from .embedding_dedup import near_vectors
from .html_extract import extract_pages
from .language_id import language_id
from .license_scan import license_scan
from .near_dedup import near_duplicates
from .ngram_lm import score_texts
from .packing import pack
from .secret_scan import secret_findings
from .sentencepiece_codec import sentencepiece_codec
from .token_files import read_shards, write_shards


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), f"{scratch.base}/shards", scratch=scratch))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_minhash_near_dedup, op2_license_scans, op3_packing, op4_quality_rules, op5_sentencepiece, op6_html_extraction, op7_embedding_near_dedup, op8_language_id, op9_token_files, op10_secret_scans,
        op11_importance_resampling, op12_filter_audit, op13_lm_scoring,
    )
}
ORACLES: dict[str, str] = {"op4_quality_rules": rules.oracle_sql(), "op11_importance_resampling": resampling.oracle_sql(), "op12_filter_audit": audit.oracle_sql()}
