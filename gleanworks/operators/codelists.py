"""Code lists: usage counts, coverage, orphan codes, mapping suggestions and decoding.

``codes`` tables are (attribute, code, labels map<string,string>). A code list is joined, not broadcast by force:
Spark's size threshold decides, so a list of any size works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlap import overlaps


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Uses of each non-empty value: value, n, most used first, then by value."""
    v = F.col(column).cast("string")
    return rows.where(v.isNotNull() & (v != "")).groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def record_keys(path: DataFrame, column: str, value: str, key: str) -> DataFrame:
    """Distinct record keys that carry a value, sorted; ``path`` is the table joined up to its records."""
    return path.where(F.col(column) == value).select(key).distinct().orderBy(key)


def code_coverage(used: DataFrame, codes: DataFrame, language: str) -> DataFrame:
    """used(value, n) with share of uses, in_codelist and label (which may be present and empty)."""
    listed = codes.select(F.col("code").alias("value"), F.col("labels")[language].alias("label"), F.lit(True).alias("in_codelist"))
    total = used.agg(F.sum("n").alias("total"))
    joined = used.join(listed, "value", "left").join(total)
    return joined.select("value", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "label", F.coalesce("in_codelist", F.lit(False)).alias("in_codelist"))


def coverage_status(covered: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: total, labelled, coverage (0 of nothing is 0), status missing / partial / ok."""
    n_codes = codes.agg(F.count("*").alias("n_codes"))
    out = covered.agg(F.count("*").alias("total"), F.count("label").alias("labelled")).join(n_codes)
    coverage = F.coalesce(F.try_divide(F.col("labelled").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    status = F.when(F.col("n_codes") == 0, "missing").when(F.col("labelled") < F.col("total"), "partial").otherwise("ok")
    return out.select("total", "labelled", F.round(coverage, 9).alias("coverage"), status.alias("status"))


def orphan_codes(rows: DataFrame, column: str, key: str, codes: DataFrame) -> DataFrame:
    """Used values that the list lacks: value, n_records. Record keys come from ``record_keys`` of one value."""
    v = F.col(column).cast("string")
    used = rows.where(v.isNotNull() & (v != "")).select(v.alias("value"), F.col(key).alias("k")).join(codes.select(F.col("code").alias("value")), "value", "left_anti")
    return used.groupBy("value").agg(F.countDistinct("k").alias("n_records"))


def mapping_suggest(values: DataFrame, codes: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """columns(column, attribute, jaccard): the attribute whose codes contain all of a column's two or more distinct
    values with the highest Jaccard, if only one has it. A copied mapping (column, attribute) comes first; one to an
    attribute that is unknown suggests nothing.

    Columns and attributes meet on their codes, and codes that lie in the same of them count together.
    """
    v = values.select("column", "value").distinct()
    c = codes.select("attribute", F.col("code").alias("value")).distinct()
    n_values, n_codes = v.groupBy("column").agg(F.count("*").alias("nv")), c.groupBy("attribute").agg(F.count("*").alias("nc"))
    both = overlaps(v.select(F.col("column").alias("name"), F.col("value").alias("k")), c.select(F.col("attribute").alias("name"), F.col("value").alias("k"))).toDF("column", "attribute", "common")
    scored = both.join(n_values, "column").join(n_codes, "attribute").where("common = nv AND nv >= 2").withColumn("jaccard", F.col("common") / (F.col("nv") + F.col("nc") - F.col("common")))
    best = scored.withColumn("r", F.rank().over(Window.partitionBy("column").orderBy(F.desc("jaccard")))).where("r = 1")
    best = best.withColumn("n", F.count("*").over(Window.partitionBy("column"))).where("n = 1").select("column", "attribute", F.round("jaccard", 9).alias("jaccard"))
    if copied is None:
        return best
    known = copied.join(c.select("attribute").distinct(), "attribute", "left_semi").select("column", "attribute", F.lit(None).cast("double").alias("jaccard"))
    return best.join(copied.select("column"), "column", "left_anti").select("column", "attribute", "jaccard").unionByName(known)


def unresolved_copies(copied: DataFrame, suggestions: DataFrame, attributes: DataFrame) -> DataFrame:
    """Copied mappings (column, attribute) that suggest nothing, with the reason."""
    left = copied.join(suggestions.select("column"), "column", "left_anti")
    known = attributes.select("attribute").distinct().withColumn("known", F.lit(True))
    return left.join(known, "attribute", "left").select("column", "attribute", F.when(F.col("known"), "column not in corpus").otherwise("attribute unknown").alias("reason"))


def unique_enum_columns(columns: DataFrame) -> DataFrame:
    """Coded columns whose name occurs in one table only."""
    enums = columns.where("type_hint = 'enum'")
    return enums.withColumn("n", F.count("*").over(Window.partitionBy("column_name"))).where("n = 1").drop("n")


def default_source(corpora: DataFrame, mapped: DataFrame) -> DataFrame:
    """For each corpus(corpus_id, name, version, created) the one to copy mappings from: the highest lower version of its
    name that has mappings, else the newest other that has. Found by windows over the name and over creation, not pairwise."""
    has = corpora.join(mapped.select("corpus_id").distinct().withColumn("m", F.lit(True)), "corpus_id", "left")
    own = F.when(F.col("m"), F.struct("version", "corpus_id"))
    before = F.max(own).over(Window.partitionBy("name").orderBy("version").rangeBetween(Window.unboundedPreceding, -1))
    newest = has.where("m").orderBy(F.desc("created"), F.desc("corpus_id")).limit(2).agg(F.sort_array(F.collect_list(F.struct("created", "corpus_id")), asc=False).alias("new"))
    other = F.get(F.filter("new", lambda x: x["corpus_id"] != F.col("corpus_id")), F.lit(0))["corpus_id"]
    return has.withColumn("b", before).join(newest).select("corpus_id", F.coalesce(F.col("b.corpus_id"), other).alias("source_id"))


def decode_label(rows: DataFrame, value: str, codes: DataFrame, language: str) -> DataFrame:
    """``rows`` with label and label_state by exact code: empty, not_enum (there is no code list), not_in_table, no_label
    (the language is absent) or labelled (the label may be empty)."""
    listed = codes.select(F.col("code").alias("_code"), "labels")
    n = codes.agg(F.count("*").alias("_n"))
    joined = rows.join(listed, F.col(value) == F.col("_code"), "left").join(n)
    label = F.col("labels")[language]
    state = F.when(F.coalesce(F.col(value), F.lit("")) == "", "empty").when(F.col("_n") == 0, "not_enum").when(F.col("_code").isNull(), "not_in_table").when(label.isNull(), "no_label").otherwise("labelled")
    return joined.withColumns({"label": label, "label_state": state}).drop("_code", "labels", "_n")


def columns_mapping(columns: DataFrame, mapping: DataFrame, coverage: DataFrame, features: DataFrame) -> DataFrame:
    """Every census column with its attribute, coverage and the features that use it."""
    users = features_using_column(features)
    return columns.join(mapping, "column_name", "left").join(coverage, "column_name", "left").join(users, "column_name", "left")


def features_using_column(features: DataFrame) -> DataFrame:
    return features.where("source_column IS NOT NULL").groupBy(F.col("source_column").alias("column_name")).agg(F.array_join(F.sort_array(F.collect_set("feature_key")), "|").alias("features"))


def upsert_mapping(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The mapping (corpus_id, column_name, attribute) after changes; a null attribute removes one."""
    keep = current.join(changes.select("corpus_id", "column_name"), ["corpus_id", "column_name"], "left_anti")
    return keep.unionByName(changes.where("attribute IS NOT NULL"))


def snapshot(codes: DataFrame, attribute: str, language: str) -> DataFrame:
    """The codes of an attribute at launch; it fails where no code has a label in the prompt's language."""
    rows = codes.where(F.col("attribute") == attribute)
    checked = rows.agg(F.sort_array(F.collect_list(F.struct("code", F.col("labels")[language].alias("label")))).alias("codes"), F.count_if(F.coalesce(F.col("labels")[language], F.lit("")) != "").alias("n"))
    return checked.select(F.when(F.col("n") > 0, F.col("codes")).otherwise(F.raise_error(F.lit(f"no label of {attribute} in {language}"))).alias("codes"))
