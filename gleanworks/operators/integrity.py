"""Cross-file validation: duplicate keys, orphans, set resolution, declared counts, text keys.

All are equi-joins or grouped counts over key columns only; no side is assumed small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlap import overlaps

#: Severity of each finding.
BLOCKING = ("FILE_UNDECODABLE", "FILE_UNSUPPORTED_BOM", "FILE_CONTAINS_NUL", "HEADER_MISMATCH", "DUP_KEY_CROSS_SET", "ORPHAN_FK", "SET_UNRESOLVED", "TEXT_SCRUB_TIMEOUT")
#: Fixed value: shape of a key that a generator of test data made.
SYNTHETIC_KEY = r"^(?=.{32}$)[0-9a-fA-F]{1,4}0{10}[0-9]{0,21}$"


def duplicate_keys(rows: DataFrame, keys: list[str], file: str | None = None) -> DataFrame:
    """Non-empty keys that occur more than once over all files: the keys, n, and with ``file`` the sorted file names.

    Nearly all keys are distinct, so counting them before they travel holds them for nothing; and as they compress well, partitions
    that Spark makes up by their size in bytes hold millions. They are dealt to all the partitions that the session asks for.
    """
    present = rows
    for k in keys:
        present = present.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    extra = [F.sort_array(F.collect_set(file)).alias("files")] if file else []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    present = present.select(*keys, *([file] if file else [])).repartition(parts, *keys)
    return present.groupBy(*keys).agg(F.count("*").alias("n"), *extra).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Child rows with a non-empty foreign key that no parent has."""
    present = child.where(F.col(fk).isNotNull() & (F.col(fk).cast("string") != ""))
    return present.join(parent.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def count_mismatches(parents: DataFrame, children: DataFrame, key: str, fk: str, declared: str, n: str | None = None) -> DataFrame:
    """Parents whose declared child total is a number other than the actual one: key, declared, actual. A row of ``children``
    stands for one child, or for as many as its column ``n`` says."""
    actual = children.groupBy(F.col(fk).alias(key)).agg((F.sum(n) if n else F.count("*")).alias("actual"))
    said = F.col(declared).try_cast("long")
    joined = parents.select(key, said.alias("declared")).where("declared IS NOT NULL").join(actual, key, "left")
    return joined.select(key, "declared", F.coalesce("actual", F.lit(0)).alias("actual")).where("declared <> actual")


def two_hop_counts(parents: DataFrame, middle: DataFrame, leaves: DataFrame, key: str, middle_key: str, middle_fk: str, leaf_fk: str) -> DataFrame:
    """Leaves per parent by way of the middle table; leaves are counted per middle key before they travel."""
    per_middle = leaves.groupBy(F.col(leaf_fk).alias(middle_key)).agg(F.count("*").alias("n"))
    per_parent = middle.select(middle_key, F.col(middle_fk).alias(key)).join(per_middle, middle_key).groupBy(key).agg(F.sum("n").alias("n"))
    return parents.select(key).join(per_parent, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def text_join_check(texts: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, finding. Nothing where either side is absent."""
    present = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    t, r = (df.where(present).select(key).distinct() for df in (texts, records))
    # A side is absent when it has no row; one-row counts are joined so that this stays part of the plan.
    both = t.limit(1).select(F.lit(1).alias("x")).join(r.limit(1).select(F.lit(1).alias("x")), "x")
    found = t.join(r, key, "left_anti").select(key, F.lit("TEXT_KEY_UNMATCHED").alias("finding")).union(r.join(t, key, "left_anti").select(key, F.lit("UNFALL_WITHOUT_TEXT").alias("finding")))
    return found.withColumn("x", F.lit(1)).join(F.broadcast(both), "x", "left_semi").drop("x")


def resolve_sets(child: DataFrame, parent: DataFrame, child_file: str, child_key: str, parent_file: str, parent_key: str) -> DataFrame:
    """For each child file the parent file that shares most keys, the first of equals: file, set, overlap. Without a shared
    key the set is null. Keys that lie in the same files count together."""
    side = lambda df, file, key: df.select(F.col(file).alias("name"), F.col(key).alias("k"))
    overlap = overlaps(side(child, child_file, child_key), side(parent, parent_file, parent_key)).toDF("file", "set", "overlap")
    first = Window.partitionBy("file").orderBy(F.desc("overlap"), "set")
    best = overlap.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    files = child.select(F.col(child_file).alias("file")).distinct()
    return files.join(best, "file", "left").select("file", "set", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def all_synthetic(rows: DataFrame, key: str, pattern: str = SYNTHETIC_KEY) -> DataFrame:
    """One row: n, synthetic (there is a key and every key has the generator's shape)."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(F.col(key).rlike(pattern), F.lit(False))), F.lit(False)).alias("synthetic"))


def blocking(findings: DataFrame) -> DataFrame:
    """Findings that keep a delivery from being frozen; an unknown header blocks where its file is selected."""
    hard = F.col("code").isin(*BLOCKING)
    return findings.where(hard | (F.col("code") == "UNKNOWN_HEADER") & F.col("selected") if "selected" in findings.columns else hard)


def validate_delivery(unfall: DataFrame, objekt: DataFrame, person: DataFrame, texts: DataFrame) -> DataFrame:
    """Findings (code, key, detail) over tables of selected files.

    unfall(file, key, objects, persons), objekt(file, key, parent), person(file, key, parent), texts(file, key).
    """
    finding = lambda df, code, detail: df.select(F.lit(code).alias("code"), F.col("key").cast("string").alias("key"), detail.alias("detail"))
    named = lambda kind, *pairs: F.create_map(F.lit("table"), F.lit(kind), *(x for k, c in pairs for x in (F.lit(k), c.cast("string"))))
    parts = []
    for kind, rows in (("unfall", unfall), ("objekt", objekt), ("person", person)):
        parts.append(finding(duplicate_keys(rows, ["key"], "file"), "DUP_KEY_CROSS_SET", named(kind, ("files", F.array_join("files", "|")), ("n", F.col("n")))))
    for kind, rows, parents in (("objekt", objekt, unfall), ("person", person, objekt)):
        parts.append(finding(orphans(rows, parents, "parent", "key"), "ORPHAN_FK", named(kind, ("parent", F.col("parent")))))
    for kind, rows, parents in (("objekt", objekt, unfall), ("person", person, objekt)):
        sets = resolve_sets(rows.select("file", F.col("parent").alias("k")), parents.select(F.col("file").alias("pf"), F.col("key").alias("pk")), "file", "k", "pf", "pk")
        parts.append(sets.where("`set` IS NULL").select(F.lit("SET_UNRESOLVED").alias("code"), F.lit(None).cast("string").alias("key"), F.create_map(F.lit("table"), F.lit(kind), F.lit("filename"), F.col("file")).alias("detail")))
    counted = named("unfall", ("declared", F.col("declared")), ("actual", F.col("actual")))
    parts.append(finding(count_mismatches(unfall, objekt, "key", "parent", "objects"), "COUNT_MISMATCH_OBJ", counted))
    # Of an object key that occurs twice the last file's row says which accident it belongs to.
    owner = objekt.groupBy("key").agg(F.max_by("parent", "file").alias("parent"))
    # Persons are counted per object before they travel.
    persons = person.groupBy("parent").agg(F.count("*").alias("n")).join(owner.select(F.col("key").alias("parent"), F.col("parent").alias("accident")), "parent")
    parts.append(finding(count_mismatches(unfall, persons, "key", "accident", "persons", "n"), "COUNT_MISMATCH_PERS", counted))
    parts.append(text_join_check(texts, unfall, "key").select(F.col("finding").alias("code"), F.col("key").cast("string").alias("key"), named("text").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
