"""The pipeline's stages: what goes, what stays, what changes."""

import corpus_pipeline
import pytest

GOOD = "the cat is in the house of my friend and it is not on the table with a dog that we have seen by the old river in the north"

OTHER = "a boat was on the lake in the morning and the people of the town had come to see it with their children from the school"


@pytest.fixture(scope="module")
def docs(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, OTHER + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", "s", 5, "a.b"), (10**6 + 1, None, "en", "s", 0, None), (10**6 + 2, "### " * 50, "en", "s", 9, "x"), (10**6 + 3, GOOD, "en", "s", 9, "x"), (10**6 + 4, GOOD + " x", "en", "s", 9, "x"), (10**6 + 4, GOOD + " x", "en", "s", 9, "x"), (None, GOOD, None, None, None, None)]
    from pyspark.sql import functions as F

    return table.withColumn("score", F.lit("c")).union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score string")).repartition(3)


@pytest.fixture(scope="module")
def stages(spark, docs, sf, tmp_path_factory):
    out, folder = {"start": docs}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    for name in ("language_id", "quality_rules", "minhash_near_dedup", "secret_scans"):
        assert stages[name].columns == stages["start"].columns


def test_decisions(stages):
    big = lambda name: {d for d in ids(stages[name]) if d is None or d >= 10**6}
    n = 10**6
    assert n + 1 not in big("language_id") and n + 2 not in big("quality_rules")
    kept = big("minhash_near_dedup")
    assert None in kept and n + 3 in kept and n + 4 not in kept
    secret = {r.doc_id: r for r in stages["secret_scans"].collect()}[n]
    assert secret.text.endswith('token = "[SECRET]"') and secret.n_chars == len(secret.text)
    assert {d for d in ids(stages["packing"]) if d is None or d >= n} == kept


def test_stages_work_on_empty_tables(spark, docs, sf):
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []
