"""Scoring of answers against ground truth: cases, the three goals, languages, intervals, incremental writes.

All runs, features and languages are scored in one job: a left join on the record, one grouped count with grouping
sets, and arithmetic on the counts. Counting combines before the shuffle, so a language or feature that holds most
rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import share, wilson
from ..functions.text import classify, is_empty, matches

ALL = "*"


def cases(truth: DataFrame, answers: DataFrame, records: DataFrame) -> DataFrame:
    """truth(feature_id, record_id, record_value, value_type) and answers(run_id, feature_id, record_id, model_value,
    present) to one row per run and labelled record: outcome, language, present."""
    runs = answers.select("run_id", "feature_id").distinct()
    labelled = truth.join(records.select("record_id", F.coalesce("language", F.lit(ALL)).alias("language")), "record_id", "left")
    wanted = labelled.join(runs, "feature_id")
    joined = wanted.join(answers, ["run_id", "feature_id", "record_id"], "left")
    hit = matches(F.col("record_value"), F.col("model_value"), F.col("value_type"))
    return joined.withColumn("outcome", classify(F.col("record_value"), F.col("model_value"), hit)).where("outcome IS NOT NULL")


def _grouped(rows: DataFrame, keys: list[str], language: str, *aggregates: Column) -> DataFrame:
    """Per keys and language, and per keys over all languages (language '*'). A null language stays apart from that."""
    lang = F.coalesce(F.col(language), F.lit(""))
    named = rows.withColumn("_lang", lang)
    sets = [[F.col(k) for k in keys], [*(F.col(k) for k in keys), F.col("_lang")]]
    out = named.groupingSets(sets, *(F.col(k) for k in keys), F.col("_lang")).agg(F.grouping("_lang").alias("_all"), *aggregates)
    return out.withColumn("language", F.when(F.col("_all") == 1, ALL).otherwise(F.col("_lang"))).drop("_lang", "_all")


def goal1(rows: DataFrame, keys: list[str], language: str = "language") -> DataFrame:
    """Per keys and language (and '*'): counts, precision, recall, f1 and their intervals."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = _grouped(rows, keys, language, n("hit").alias("hit"), n("wrong").alias("wrong"), n("missing").alias("missing"))
    hit, wrong, missing = (F.col(c) for c in ("hit", "wrong", "missing"))
    claimed, total = hit + wrong, hit + wrong + missing
    f1 = share(2 * hit, claimed + total)
    p, r, f = wilson(hit, claimed), wilson(hit, total), wilson(F.rint(f1 * total), total)
    cols = {"n": total, "precision": share(hit, claimed), "recall": share(hit, total), "f1": f1, "precision_low": p[0], "precision_high": p[1], "recall_low": r[0], "recall_high": r[1], "f1_low": f[0], "f1_high": f[1]}
    return out.withColumns({k: v if k == "n" else F.round(v, 9) for k, v in cols.items()})


def goal2(rows: DataFrame, keys: list[str], language: str = "language", present: str = "present") -> DataFrame:
    """Presence: the rate over all cases, inconsistency (hit though called absent) over flagged ones, and the 6-cell cross-tab."""
    p, o = F.col(present), F.col("outcome")
    cells = [F.count_if((o == name) & (p == flag)).alias(f"{name}_{'present' if flag else 'absent'}") for name in ("hit", "wrong", "missing") for flag in (True, False)]
    out = _grouped(rows, keys, language, F.count("*").alias("n"), F.count(p).alias("flagged"), F.count_if(p).alias("n_present"), *cells)
    rate, inconsistent = wilson(F.col("n_present"), F.col("n")), wilson(F.col("hit_absent"), F.col("flagged"))
    cols = {"presence_rate": share(F.col("n_present"), F.col("n")), "presence_low": rate[0], "presence_high": rate[1], "inconsistency": share(F.col("hit_absent"), F.col("flagged")), "inconsistency_low": inconsistent[0], "inconsistency_high": inconsistent[1]}
    return out.withColumns({k: F.round(v, 9) for k, v in cols.items()})


def goal3(answers: DataFrame, keys: list[str], language: str = "language", value: str = "model_value", span: str = "evidence") -> DataFrame:
    """Exploratory features: the rate of reported values, and how many carry a span."""
    out = _grouped(answers, keys, language, F.count("*").alias("n"), F.count(value).alias("reported"), F.count_if(~is_empty(F.col(span))).alias("spans"))
    return out.withColumn("reported_rate", F.round(share(F.col("reported"), F.col("n")), 9))


def long_scores(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, language, metric, value) of chosen columns."""
    return wide.unpivot([*keys, "language"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def mismatches(rows: DataFrame) -> DataFrame:
    """The wrong cases: run_id, record_id, feature_id, record_value, model_value."""
    return rows.where("outcome = 'wrong'").select("run_id", "record_id", "feature_id", "record_value", "model_value")


def unscored(features: DataFrame, scores: DataFrame) -> DataFrame:
    """(run_id, feature_id) without a score yet."""
    return features.join(scores.select("run_id", "feature_id").distinct(), ["run_id", "feature_id"], "left_anti")


def write_scores(scores: DataFrame, path: str) -> None:
    """Replace the partitions (run_id, feature_id) that the new scores have; others stay as they are."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "feature_id").parquet(path)


def scoreable_count(features: DataFrame, populated: DataFrame) -> DataFrame:
    """One row: derived features plus native ones whose column has a value somewhere."""
    native = features.where("source_column IS NOT NULL").join(populated.select("source_column").distinct(), "source_column", "left_semi").agg(F.count("*").alias("a"))
    derived = features.where("source_column IS NULL AND derivation IS NOT NULL").agg(F.count("*").alias("b"))
    return native.join(derived).select((F.col("a") + F.col("b")).alias("scoreable"))


def scoring_status(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Per run: features to score and features scored."""
    done = scores.select("run_id", "feature_id").distinct().groupBy("run_id").agg(F.count("*").alias("scored"))
    return features.groupBy("run_id").agg(F.countDistinct("feature_id").alias("scoreable")).join(done, "run_id", "left").fillna(0, ["scored"])
