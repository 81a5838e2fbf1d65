"""Queries on integrity, census, code lists and derivations."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, read, scratch_dir
from ..operators import census, codelists, corpus, derive, integrity, overlap, paging
from ..operators.census_store import CensusStore
from ..operators.derive import Filter
from ..sources import exports

# --- census --------------------------------------------------------------------------------------------------------

TABLES = {"customer": ("c_custkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")}
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
DOUBLES = {"c_acctbal", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _text(c: str) -> str:
    return f"coalesce(CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR), '')" if c in DOUBLES else f"coalesce(CAST({c} AS VARCHAR), '')"


def _cells_sql(tables: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({TABLES[t][0]} AS VARCHAR) AS row_key, {TABLES[t][0]} AS seq, '{c}' AS column_name, {_text(c)} AS value_raw FROM {t}" for t in tables for c in COLUMNS[t])


def _columns(spark: SparkSession, sf: str, tables: list[str]) -> list[DataFrame]:
    return [c for t in tables for c in census.column_counts(read(spark, sf, t).select(*COLUMNS[t]), t, TABLES[t][0])]


def _values(spark: SparkSession, sf: str, tables: list[str]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, _columns(spark, sf, tables))


def _headers(spark: SparkSession, tables: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, c) for t in tables for c in COLUMNS[t]], "table_name string, column_name string")


def _values_sql(tables: list[str]) -> str:
    return f"SELECT table_name, column_name, value_raw, count(*) AS n, min(seq) AS first FROM ({_cells_sql(tables)}) WHERE value_raw <> '' GROUP BY ALL"


ALL = list(TABLES)
_COUNTED = f"SELECT table_name, column_name, sum(n)::BIGINT AS populated_count, count(*)::BIGINT AS distinct_count, max(n)::BIGINT AS top FROM ({_values_sql(ALL)}) GROUP BY ALL"
_CENSUS = f"""SELECT c.table_name, c.column_name, populated_count, distinct_count, round(populated_count::DOUBLE / r.n, 9) AS populated_rate,
 round(top::DOUBLE / populated_count, 9) AS top_value_share, distinct_count > 20 AND top::DOUBLE / populated_count < 0.01 AS long_tail,
 CASE WHEN populated_count = 0 THEN 'empty' WHEN populated_count::DOUBLE / r.n <= 0.2 THEN '0-20' WHEN populated_count::DOUBLE / r.n <= 0.5 THEN '20-50' WHEN populated_count::DOUBLE / r.n <= 0.8 THEN '50-80' WHEN populated_count::DOUBLE / r.n <= 0.99 THEN '80-99' ELSE '99-100' END AS bucket
 FROM ({_COUNTED}) c, (SELECT count(*) AS n FROM customer) r"""


def _census(spark: SparkSession, sf: str) -> DataFrame:
    records = read(spark, sf, "customer").agg(F.count("*").alias("_records"))
    headers = _headers(spark, ALL).join(records)
    return census.census_columns(_values(spark, sf, ALL), headers, F.col("_records")).drop("_records")


@query("melt_cells", f"SELECT table_name, row_key, column_name, value_raw FROM ({_cells_sql(['customer', 'orders'])})")
def melt_cells(spark, sf):
    return census.melt_cells(read(spark, sf, "customer").select(*COLUMNS["customer"]), "customer", "c_custkey").unionByName(census.melt_cells(read(spark, sf, "orders").select(*COLUMNS["orders"]), "orders", "o_orderkey"))


@query("census_growing", _CENSUS)
def census_growing(spark, sf):
    """The census of a store that got the tables as two deliveries, the later with orders and items of later years."""
    dates = {"orders": "o_orderdate", "lineitem": "l_shipdate"}

    def cells(t: str, early: bool) -> DataFrame:
        rows = read(spark, sf, t)
        is_early = F.coalesce(F.year(dates[t]) <= 1997, F.lit(False)) if t in dates else F.lit(True)
        return census.melt_cells(rows.where(is_early if early else ~is_early).select(*COLUMNS[t]), t, TABLES[t][0])

    store = CensusStore(spark, scratch_dir(spark, "census"), buckets=16)
    for early in (True, False):
        store.add(functools.reduce(DataFrame.unionByName, [cells(t, early) for t in ALL]).withColumn("seq", F.col("row_key").cast("long")))
    return store.columns("customer")


@query("census_columns", _CENSUS)
def census_columns(spark, sf):
    return _census(spark, sf)


@query("census_long_tail", f"SELECT table_name, column_name, long_tail FROM ({_CENSUS})")
def census_long_tail(spark, sf):
    return _census(spark, sf).select("table_name", "column_name", "long_tail")


@query("census_top_values", f"""SELECT table_name, column_name, value_rank::BIGINT AS value_rank, value_raw, n::BIGINT AS n, round(n / total, 9) AS share FROM (
 SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, first, value_raw) AS value_rank, sum(n) OVER (PARTITION BY table_name, column_name) AS total FROM ({_values_sql(ALL)})) WHERE value_rank <= 20""")
def census_top_values(spark, sf):
    return census.top_of_columns(_columns(spark, sf, ALL)).withColumn("value_rank", F.col("value_rank").cast("long"))


@query("census_buckets", f"SELECT l.bucket, count(c.column_name)::BIGINT AS n FROM (VALUES ('empty'), ('0-20'), ('20-50'), ('50-80'), ('80-99'), ('99-100')) l(bucket) LEFT JOIN ({_CENSUS}) c ON l.bucket = c.bucket GROUP BY 1")
def census_buckets(spark, sf):
    return census.bucket_counts(_census(spark, sf))


@query("census_list", f"SELECT *, count(*) OVER ()::BIGINT AS total FROM ({_CENSUS}) WHERE populated_rate >= 0.5 AND table_name = 'orders' ORDER BY distinct_count DESC, table_name, column_name LIMIT 3 OFFSET 1")
def census_list(spark, sf):
    return census.census_page(_census(spark, sf), "orders", 0.5, "distinct_count", offset=1, limit=3)


@query("census_summary", f"SELECT table_name, count(*)::BIGINT AS n_columns FROM ({_CENSUS}) GROUP BY 1 UNION ALL SELECT '*', count(*)::BIGINT FROM ({_CENSUS})")
def census_summary(spark, sf):
    return census.census_summary(_census(spark, sf))


_HINT_TABLES = ["customer", "orders"]
_DATE = r"(regexp_full_match(value_raw, '\d{8}') AND try_cast(substr(value_raw, 1, 4) AS INT) BETWEEN 1900 AND 2100 AND try_cast(substr(value_raw, 5, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr(value_raw, 7, 2) AS INT) BETWEEN 1 AND 31)"
_HINTS = rf"""SELECT table_name, column_name, CASE WHEN bool_and({_DATE}) THEN 'date' WHEN bool_and(regexp_full_match(value_raw, '([01]\d|2[0-3]):[0-5]\d')) THEN 'time'
 WHEN bool_and(regexp_full_match(value_raw, '\s*[+-]?\d+\s*')) THEN 'integer' WHEN bool_and(regexp_full_match(value_raw, '\s*[+-]?(\d+\.?\d*|\.\d+)\s*')) THEN 'decimal' ELSE 'text' END AS type_hint FROM ({_values_sql(_HINT_TABLES)}) GROUP BY ALL"""


def _hints(spark, sf):
    return census.type_hints(_values(spark, sf, _HINT_TABLES), _headers(spark, _HINT_TABLES))


@query("census_type_hint", _HINTS)
def census_type_hint(spark, sf):
    return _hints(spark, sf)


@query("census_sample_rule", f"""SELECT c.table_name, c.column_name, CASE WHEN c.table_name = 'orders' THEN 'enum' ELSE 'text' END AS type_hint, CASE WHEN c.table_name = 'orders' THEN t.vs END AS samples, c.table_name <> 'orders' AS withheld FROM ({_CENSUS}) c JOIN (
 SELECT table_name, column_name, string_agg(value_raw, '|' ORDER BY value_rank) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, first, value_raw) AS value_rank FROM ({_values_sql(_HINT_TABLES)})) WHERE value_rank <= 3 GROUP BY ALL) t USING (table_name, column_name)""")
def census_sample_rule(spark, sf):
    values = _values(spark, sf, _HINT_TABLES)
    columns = _headers(spark, _HINT_TABLES).withColumn("type_hint", F.when(F.col("table_name") == "orders", "enum").otherwise("text"))
    shown = census.with_samples(columns, census.top_values(values, 3))
    return shown.select("table_name", "column_name", "type_hint", F.array_join(F.transform("top_values", lambda x: x["value_raw"]), "|").alias("samples"), "withheld")


@query("census_in_config", f"SELECT table_name, column_name, column_name IN ('o_orderstatus', 'c_mktsegment') AS in_config FROM ({_CENSUS})")
def census_in_config(spark, sf):
    features = spark.createDataFrame([("o_orderstatus",), ("c_mktsegment",), (None,)], "source_column string")
    return census.census_in_config(_census(spark, sf), features).select("table_name", "column_name", "in_config")


# --- integrity -----------------------------------------------------------------------------------------------------


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf):
    return integrity.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_fk", "SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey % 10 <> 0)")
def orphan_fk(spark, sf):
    parents = read(spark, sf, "customer").where("c_custkey % 10 <> 0")
    return integrity.orphans(read(spark, sf, "orders"), parents, "o_custkey", "c_custkey").select("o_custkey", "o_orderkey")


@query("count_mismatch", "SELECT o_orderkey, o_orderkey % 7 AS declared, coalesce(n, 0)::BIGINT AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> coalesce(n, 0)")
def count_mismatch(spark, sf):
    parents = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("string").alias("declared"))
    return integrity.count_mismatches(parents, read(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "declared")


@query("two_hop_count", "SELECT c_custkey, count(l_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def two_hop_count(spark, sf):
    return integrity.two_hop_counts(read(spark, sf, "customer"), read(spark, sf, "orders"), read(spark, sf, "lineitem"), "c_custkey", "o_orderkey", "o_custkey", "l_orderkey")


@query("text_join_check", "SELECT doc_id, 'TEXT_KEY_UNMATCHED' AS finding FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'UNFALL_WITHOUT_TEXT' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def text_join_check(spark, sf):
    return integrity.text_join_check(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")


@query("resolve_sets", """WITH c AS (SELECT DISTINCT o_orderpriority AS file, o_custkey AS k FROM orders), p AS (SELECT DISTINCT c_mktsegment AS "set", c_custkey AS k FROM customer),
 o AS (SELECT file, "set", count(*) AS overlap FROM c JOIN p USING (k) GROUP BY ALL)
 SELECT file, "set", overlap::BIGINT AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY overlap DESC, "set") AS rn FROM o) WHERE rn = 1""")
def resolve_sets(spark, sf):
    return integrity.resolve_sets(read(spark, sf, "orders"), read(spark, sf, "customer"), "o_orderpriority", "o_custkey", "c_mktsegment", "c_custkey")


@query("synthetic_keys", "SELECT count(*)::BIGINT AS n, bool_and(regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS synthetic FROM customer")
def synthetic_keys(spark, sf):
    return integrity.all_synthetic(read(spark, sf, "customer"), "c_name", r"^Customer#[0-9]{9}$")


def _findings(spark, sf, more_objects: DataFrame | None = None):
    o, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    unfall = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("key"), (F.col("c_custkey") % 20).cast("string").alias("objects"), F.lit("x").alias("persons"))
    objekt = o.select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(F.col("o_custkey")).alias("parent"))
    if more_objects is not None:
        objekt = objekt.unionByName(more_objects)
    person = lines.select(F.col("l_returnflag").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_orderkey").alias("parent"))
    texts = read(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("key"))
    return integrity.validate_delivery(unfall, objekt, person, texts)


_FINDINGS = """SELECT 'DUP_KEY_CROSS_SET' AS code, count(*)::BIGINT AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1)
 UNION ALL SELECT 'ORPHAN_FK', count(*) FROM orders WHERE o_orderkey % 50 = 0
 UNION ALL SELECT 'COUNT_MISMATCH_OBJ', count(*) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS a FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 20 <> coalesce(a, 0)
 UNION ALL SELECT 'TEXT_KEY_UNMATCHED', count(*) FROM documents WHERE doc_id NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'UNFALL_WITHOUT_TEXT', count(*) FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)"""


@query("validate_delivery", f"SELECT * FROM ({_FINDINGS}) WHERE n > 0")
def validate_delivery(spark, sf):
    return _findings(spark, sf).groupBy("code").agg(F.count("*").alias("n"))


_KEYED = """SELECT 'DUP_KEY_CROSS_SET' AS code, CAST(k AS VARCHAR) AS key, 'files=' || string_agg(DISTINCT f, '|' ORDER BY f) || ' n=' || count(*) AS detail FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_returnflag AS f FROM lineitem) GROUP BY k HAVING count(*) > 1
 UNION ALL SELECT 'ORPHAN_FK', CAST(o_orderkey AS VARCHAR), 'parent=-1' FROM orders WHERE o_orderkey % 50 = 0
 UNION ALL SELECT 'SET_UNRESOLVED', NULL, 'filename=lost'
 UNION ALL SELECT 'COUNT_MISMATCH_OBJ', CAST(c_custkey AS VARCHAR), 'actual=' || coalesce(a, 0) || ' declared=' || c_custkey % 20 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS a FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 20 <> coalesce(a, 0)
 UNION ALL SELECT 'TEXT_KEY_UNMATCHED', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'UNFALL_WITHOUT_TEXT', CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)"""


@query("validate_delivery_rows", f"{_KEYED} UNION ALL SELECT 'ORPHAN_FK', '-7', 'parent=-9'")
def validate_delivery_rows(spark, sf):
    """Every finding with key and detail; one more file of objects shares no key with any accident."""
    found = _findings(spark, sf, spark.createDataFrame([("lost", -7, -9)], "file string, key long, parent long"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("detail", lambda k, _: k != "table"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return found.select("code", "key", shown.alias("detail"))


@query("blocking_filter", f"SELECT * FROM ({_FINDINGS}) WHERE n > 0 AND code IN ('DUP_KEY_CROSS_SET', 'ORPHAN_FK')")
def blocking_filter(spark, sf):
    return integrity.blocking(_findings(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))


@query("majority_canton", "SELECT o_orderpriority AS file, value FROM (SELECT o_orderpriority, trim(o_orderstatus) AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, trim(o_orderstatus)) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def majority_canton(spark, sf):
    from ..sources.delivery import majority

    return majority(read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").withColumnRenamed("o_orderpriority", "file")


# --- corpus --------------------------------------------------------------------------------------------------------


@query("narrative_join", """SELECT c_custkey, CASE WHEN t <> '' THEN t ELSE c_name END AS narrative, (t IS NULL OR t = '') AND c_name <> '' AS from_anonymised FROM customer LEFT JOIN
 (SELECT k, t FROM (SELECT doc_id // 2 AS k, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS t, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1) ON k = c_custkey""")
def narrative_join(spark, sf):
    texts = read(spark, sf, "documents").select(F.expr("doc_id div 2").alias("c_custkey"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("t"))
    return corpus.narratives(read(spark, sf, "customer"), texts, "c_custkey", "t", "doc_id", "c_name").select("c_custkey", "narrative", "from_anonymised")


@query("hierarchy_build", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n_objects, coalesce(sum(n), 0)::BIGINT AS n_persons FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def hierarchy_build(spark, sf):
    return corpus.hierarchy(read(spark, sf, "customer"), read(spark, sf, "orders"), read(spark, sf, "lineitem"), "c_custkey", "o_orderkey", "o_custkey", "l_orderkey").select("c_custkey", "n_objects", "n_persons")


@query("language_counts", "SELECT lang AS language, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def language_counts(spark, sf):
    return corpus.language_counts(read(spark, sf, "documents"), "lang")


_CHARS = "éèüöñ"


@query("canary_count", f"SELECT sum(length(text) - length(translate(text, '{_CHARS}', '')))::BIGINT AS n FROM documents")
def canary_count(spark, sf):
    return corpus.canary_count(read(spark, sf, "documents"), "text", _CHARS)


@query("canary_by_char", " UNION ALL ".join(f"SELECT '{c}' AS char, sum(length(text) - length(translate(text, '{c}', '')))::BIGINT AS n FROM documents" for c in _CHARS))
def canary_by_char(spark, sf):
    return corpus.canary_by_char(read(spark, sf, "documents"), "text", _CHARS)


@query("corpus_version", "SELECT c_mktsegment AS name, (max(c_nationkey) + 1)::BIGINT AS next_version FROM customer GROUP BY 1")
def corpus_version(spark, sf):
    return corpus.next_version(read(spark, sf, "customer"), "c_mktsegment", "c_nationkey").select(F.col("c_mktsegment").alias("name"), F.col("next_version").cast("long"))


@query("citing_counts", "SELECT n_nationkey, count(c_custkey)::BIGINT AS n_citing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 3 = 0 GROUP BY 1")
def citing_counts(spark, sf):
    return corpus.citing_counts(read(spark, sf, "nation"), read(spark, sf, "customer").where("c_custkey % 3 = 0"), "n_nationkey", "c_nationkey")


@query("corpus_summary", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0))::BIGINT AS cited FROM customer")
def corpus_summary(spark, sf):
    return corpus.corpus_summary(read(spark, sf, "customer"), read(spark, sf, "orders").where("o_orderkey % 40 = 0"), "c_custkey", "o_custkey")


@query("first_record", "SELECT c_mktsegment, min(c_custkey) AS first_record FROM customer GROUP BY 1")
def first_record(spark, sf):
    return corpus.first_record(read(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@query("ruleset_corpus_counts", "SELECT n_regionkey AS version, count(*)::BIGINT AS n FROM nation WHERE n_regionkey <> 3 GROUP BY 1")
def ruleset_corpus_counts(spark, sf):
    versions = read(spark, sf, "nation").select(F.when(F.col("n_regionkey") != 3, F.col("n_regionkey")).alias("version"))
    return corpus.ruleset_counts(versions, "version")


@query("paged_lists", "SELECT c_custkey, c_mktsegment, count(*) OVER ()::BIGINT AS total FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 25 OFFSET 50")
def paged_lists(spark, sf):
    return corpus.page(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", descending=True, offset=50, limit=25)


_ORDERED = "ORDER BY o_totalprice DESC, o_orderkey"


@query("stored_page", f"SELECT o_orderkey, o_totalprice, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER ()::BIGINT AS total FROM orders) {_ORDERED} LIMIT 40 OFFSET 1000")
def stored_page(spark, sf):
    """A page far back in a list that is stored in its order."""
    path = scratch_dir(spark, "list")
    rows = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    paging.store(rows, path, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return paging.page(spark, path, 1000, 40)


@query("shared_keys", """SELECT l, r, count(*)::BIGINT AS overlap FROM (SELECT DISTINCT o_orderpriority AS l, o_custkey AS k FROM orders) JOIN (SELECT DISTINCT c_mktsegment AS r, c_custkey AS k FROM customer) USING (k) GROUP BY ALL""")
def shared_keys(spark, sf):
    """Customers that the orders of each priority share with each segment."""
    left = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("k"))
    return overlap.overlaps(left, read(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("k")))


# --- code lists ----------------------------------------------------------------------------------------------------


def _codes(spark, sf):
    """Nations of regions 0-2 as a code list; labels in two languages, one language empty for even codes."""
    n = read(spark, sf, "nation").where("n_regionkey <= 2")
    fr = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.lower("n_name"))
    return n.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("attribute"), F.col("n_nationkey").cast("string").alias("code"), F.create_map(F.lit("de"), F.col("n_name"), F.lit("fr"), fr).alias("labels"))


@query("value_counts", "SELECT o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, value")
def value_counts(spark, sf):
    return codelists.value_counts(read(spark, sf, "orders"), "o_orderstatus")


def _path(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("record_keys_for_value", "SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' ORDER BY 1")
def record_keys_for_value(spark, sf):
    return codelists.record_keys(_path(spark, sf), "l_returnflag", "R", "o_custkey")


_USED = "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY 1"
_COVERED = f"SELECT value, u.n::BIGINT AS n, round(u.n / (SELECT sum(n) FROM ({_USED})), 9) AS share, CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_nationkey % 2 = 0 THEN '' ELSE lower(n_name) END AS label, n_nationkey IS NOT NULL AS in_codelist FROM ({_USED}) u LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON CAST(n_nationkey AS VARCHAR) = value"


def _covered(spark, sf):
    return codelists.code_coverage(codelists.value_counts(read(spark, sf, "customer"), "c_nationkey"), _codes(spark, sf), "fr")


@query("code_coverage", _COVERED)
def code_coverage(spark, sf):
    return _covered(spark, sf)


@query("coverage_status", f"SELECT count(*)::BIGINT AS total, count(label)::BIGINT AS labelled, round(count(label)::DOUBLE / count(*), 9) AS coverage, CASE WHEN count(label) < count(*) THEN 'partial' ELSE 'ok' END AS status FROM ({_COVERED})")
def coverage_status(spark, sf):
    return codelists.coverage_status(_covered(spark, sf), _codes(spark, sf))


@query("orphan_codes", "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(DISTINCT c_custkey)::BIGINT AS n_records FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2) GROUP BY 1")
def orphan_codes(spark, sf):
    return codelists.orphan_codes(read(spark, sf, "customer"), "c_nationkey", "c_custkey", _codes(spark, sf))


_INT_COLUMNS = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_regionkey"), ("part", "p_size"), ("lineitem", "l_linenumber"), ("labels", "quality"), ("labels", "toxic")]
_VALUES = " UNION ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {t}" for t, c in _INT_COLUMNS)
_CODESETS = "SELECT 'nation' AS attribute, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region UNION SELECT 'size', CAST(p_size AS VARCHAR) FROM part"


def _suggestion_inputs(spark, sf):
    v = None
    for t, c in _INT_COLUMNS:
        part = read(spark, sf, t).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
        v = part if v is None else v.unionByName(part)
    sets = [("nation", "nation", "n_nationkey"), ("region", "region", "r_regionkey"), ("size", "part", "p_size")]
    codes = None
    for a, t, c in sets:
        part = read(spark, sf, t).select(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("code")).distinct()
        codes = part if codes is None else codes.unionByName(part)
    return v, codes


_SUGGEST = f"""SELECT "column", attribute, round(jaccard, 9) AS jaccard FROM (SELECT *, count(*) OVER (PARTITION BY "column") AS k FROM (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY jaccard DESC) AS r FROM (
 SELECT "column", attribute, count(*) / (nv + nc - count(*)) AS jaccard FROM ({_VALUES}) v JOIN ({_CODESETS}) c USING (value)
 JOIN (SELECT "column", count(*) AS nv FROM ({_VALUES}) GROUP BY 1) USING ("column") JOIN (SELECT attribute, count(*) AS nc FROM ({_CODESETS}) GROUP BY 1) USING (attribute)
 GROUP BY "column", attribute, nv, nc HAVING count(*) = nv AND nv >= 2)) WHERE r = 1) WHERE k = 1"""


@query("mapping_suggest", _SUGGEST)
def mapping_suggest(spark, sf):
    return codelists.mapping_suggest(*_suggestion_inputs(spark, sf))


_COPIES = [("c_nationkey", "region"), ("n_regionkey", "gone"), ("absent", "size")]


@query("mapping_suggest_copied", f"""SELECT "column", attribute, jaccard FROM ({_SUGGEST}) WHERE "column" NOT IN ('c_nationkey', 'n_regionkey', 'absent') UNION ALL SELECT 'c_nationkey', 'region', CAST(NULL AS DOUBLE) UNION ALL SELECT 'absent', 'size', CAST(NULL AS DOUBLE)""")
def mapping_suggest_copied(spark, sf):
    return codelists.mapping_suggest(*_suggestion_inputs(spark, sf), spark.createDataFrame(_COPIES, "column string, attribute string"))


@query("unresolved_copies", """SELECT 'n_regionkey' AS "column", 'gone' AS attribute, 'attribute unknown' AS reason""")
def unresolved_copies(spark, sf):
    v, codes = _suggestion_inputs(spark, sf)
    copied = spark.createDataFrame(_COPIES, "column string, attribute string")
    return codelists.unresolved_copies(copied, codelists.mapping_suggest(v, codes, copied), codes)


@query("unique_enum_columns", "SELECT * FROM (VALUES ('orders', 'o_orderstatus'), ('customer', 'c_mktsegment')) t(table_name, column_name)")
def unique_enum_columns(spark, sf):
    rows = [("orders", "o_orderstatus", "enum"), ("customer", "c_mktsegment", "enum"), ("orders", "kind", "enum"), ("lineitem", "kind", "enum"), ("orders", "o_custkey", "integer")]
    return codelists.unique_enum_columns(spark.createDataFrame(rows, "table_name string, column_name string, type_hint string")).select("table_name", "column_name")


@query("default_source", """WITH c AS (SELECT n_nationkey AS corpus_id, n_regionkey AS name, n_nationkey AS version, n_nationkey % 7 AS created, n_nationkey % 3 = 0 AS m FROM nation)
 SELECT a.corpus_id, coalesce((SELECT b.corpus_id FROM c b WHERE b.name = a.name AND b.version < a.version AND b.m ORDER BY b.version DESC, b.corpus_id DESC LIMIT 1), (SELECT b.corpus_id FROM c b WHERE b.m AND b.corpus_id <> a.corpus_id ORDER BY b.created DESC, b.corpus_id DESC LIMIT 1)) AS source_id FROM c a""")
def default_source(spark, sf):
    n = read(spark, sf, "nation")
    corpora = n.select(F.col("n_nationkey").alias("corpus_id"), F.col("n_regionkey").alias("name"), F.col("n_nationkey").alias("version"), (F.col("n_nationkey") % 7).alias("created"))
    return codelists.default_source(corpora, n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("corpus_id")))


@query("decode_label", """SELECT c_custkey, CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) WHEN n_nationkey % 2 = 0 THEN '' END AS label, CASE WHEN c_custkey % 9 = 0 THEN 'empty' WHEN n_nationkey IS NULL THEN 'not_in_table' ELSE 'labelled' END AS label_state
 FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON n_nationkey = c_nationkey AND c_custkey % 9 <> 0""")
def decode_label(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("v"))
    return codelists.decode_label(rows, "v", _codes(spark, sf), "fr").select("c_custkey", "label", "label_state")


_FEATURES = [("f1", "o_orderstatus"), ("f2", "o_orderstatus"), ("f3", "c_mktsegment"), ("f4", None)]


@query("features_using_column", "SELECT * FROM (VALUES ('o_orderstatus', 'f1|f2'), ('c_mktsegment', 'f3')) t(column_name, features)")
def features_using_column(spark, sf):
    return codelists.features_using_column(spark.createDataFrame(_FEATURES, "feature_key string, source_column string"))


@query("columns_mapping_list", f"SELECT table_name, column_name, CASE column_name WHEN 'c_nationkey' THEN 'nation' END AS attribute, CASE column_name WHEN 'c_nationkey' THEN 0.5 END::DOUBLE AS coverage, CASE column_name WHEN 'o_orderstatus' THEN 'f1|f2' WHEN 'c_mktsegment' THEN 'f3' END AS features FROM ({_CENSUS})")
def columns_mapping_list(spark, sf):
    mapping = spark.createDataFrame([("c_nationkey", "nation")], "column_name string, attribute string")
    coverage = spark.createDataFrame([("c_nationkey", 0.5)], "column_name string, coverage double")
    return codelists.columns_mapping(_headers(spark, ALL), mapping, coverage, spark.createDataFrame(_FEATURES, "feature_key string, source_column string")).select("table_name", "column_name", "attribute", "coverage", "features")


@query("apply_mappings", "SELECT c_custkey AS corpus_id, c_name AS column_name, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS attribute FROM customer WHERE c_custkey % 4 <> 1")
def apply_mappings(spark, sf):
    current = read(spark, sf, "customer").select(F.col("c_custkey").alias("corpus_id"), F.col("c_name").alias("column_name"), F.col("c_mktsegment").alias("attribute"))
    changes = current.where("corpus_id % 4 <= 1").withColumn("attribute", F.when(F.col("corpus_id") % 4 == 0, "new"))
    return codelists.upsert_mapping(current, changes)


# --- derivations ---------------------------------------------------------------------------------------------------


def _children(spark, sf):
    return read(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey"))


@query("derive_count", "SELECT c_custkey, CAST(count(o_orderkey) AS VARCHAR) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def derive_count(spark, sf):
    return derive.derive_count(read(spark, sf, "customer"), _children(spark, sf), "c_custkey", Filter("o_orderstatus", "eq", "F"))


@query("derive_any", "SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN 'true' ELSE 'false' END AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def derive_any(spark, sf):
    return derive.derive_any(read(spark, sf, "customer"), _children(spark, sf), "c_custkey", Filter("o_orderpriority", "in", ("1-URGENT", "2-HIGH")))


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("derive_max_ordinal", "SELECT c_custkey, min(o_orderpriority) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def derive_max_ordinal(spark, sf):
    return derive.derive_ordinal(read(spark, sf, "customer"), _children(spark, sf), "c_custkey", "o_orderpriority", _ORDER)


@query("derive_min_ordinal", "SELECT c_custkey, max(o_orderpriority) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def derive_min_ordinal(spark, sf):
    return derive.derive_ordinal(read(spark, sf, "customer"), _children(spark, sf), "c_custkey", "o_orderpriority", _ORDER, highest=False)


@query("derive_distinct", "SELECT c_custkey, CAST(count(DISTINCT o_orderstatus) AS VARCHAR) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def derive_distinct(spark, sf):
    return derive.derive_distinct(read(spark, sf, "customer"), _children(spark, sf), "c_custkey", "o_orderstatus")


_NULLABLE = "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '  ' ELSE o_orderstatus END"
_RULES = {"eq": ("F", "v = 'F'"), "ne": ("F", "v <> 'F'"), "in": (("F", "O"), "v IN ('F', 'O')"), "not_in": (("F", "O"), "v NOT IN ('F', 'O')"), "is_empty": (None, "v IS NULL OR trim(v) = ''"), "is_not_empty": (None, "NOT (v IS NULL OR trim(v) = '')")}


@query("row_filter", "SELECT o_orderkey, " + ", ".join(f"coalesce({sql}, false) AS r_{name}" for name, (_, sql) in _RULES.items()) + f", false AS r_missing FROM (SELECT o_orderkey, {_NULLABLE} AS v FROM orders)")
def row_filter(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.expr(_NULLABLE).alias("v"))
    return rows.select("o_orderkey", *(derive.row_filter(Filter("v", name, value), rows.columns).alias(f"r_{name}") for name, (value, _) in _RULES.items()), derive.row_filter(Filter("absent", "ne", "F"), rows.columns).alias("r_missing"))


@query("projections", "SELECT c_custkey, o_orderkey, l_linenumber, l_returnflag FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def projections(spark, sf):
    return read(spark, sf, "customer").join(_path(spark, sf), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "l_linenumber", "l_returnflag")


@query("ground_truth", "SELECT 'segment' AS feature_id, c_custkey AS record_id, c_mktsegment AS record_value FROM customer UNION ALL SELECT 'orders', c_custkey, CAST(count(o_orderkey) AS VARCHAR) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ground_truth(spark, sf):
    customer = read(spark, sf, "customer")
    return derive.ground_truth({"segment": customer.select("c_custkey", F.col("c_mktsegment").alias("value")), "orders": derive.derive_count(customer, _children(spark, sf), "c_custkey")})


@query("set_fingerprint", "SELECT c_nationkey, sha256(string_agg(c_mktsegment, chr(10) ORDER BY c_mktsegment)) AS set_fingerprint FROM customer GROUP BY 1")
def set_fingerprint(spark, sf):
    return derive.set_fingerprint(read(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("template_fingerprint", "SELECT item_id, sha256(text) AS template_fingerprint FROM benchmark")
def template_fingerprint(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("template_fingerprint"))


@query("config_version", "SELECT c_mktsegment AS name, (max(c_custkey) + 1)::BIGINT AS next_version FROM customer GROUP BY 1")
def config_version(spark, sf):
    return corpus.next_version(read(spark, sf, "customer"), "c_mktsegment", "c_custkey").withColumnRenamed("c_mktsegment", "name")


# --- catalogue of features, files, freeze ----------------------------------------------------------------------------


@query("feature_fingerprint", """SELECT n_nationkey, sha256('{"kind":"labelled","grain":"record","source_column":"' || n_name || '","derivation_json":null,"value_type":"enum","matching_rule_json":null,"enum_codelist_json":null,"description":"d' || n_regionkey || '"}') AS fingerprint FROM nation""")
def feature_fingerprint(spark, sf):
    @F.pandas_udf("string")
    def fingerprint(names: pd.Series, regions: pd.Series) -> pd.Series:
        return pd.Series([derive.feature_fingerprint({"kind": "labelled", "grain": "record", "source_column": n, "value_type": "enum", "description": f"d{r}", "colour": "ignored"}) for n, r in zip(names, regions, strict=True)])

    return read(spark, sf, "nation").select("n_nationkey", fingerprint("n_name", "n_regionkey").alias("fingerprint"))


@query("feature_validation", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'labelled feature at a grain without one value a record' ELSE 'coded feature without a code list' END AS problem FROM nation WHERE n_nationkey % 3 < 2")
def feature_validation(spark, sf):
    def work(batches):
        for b in batches:
            rows = [(k, p) for k, n in zip(b.n_nationkey, b.n_name, strict=True) for _, p in derive.validate_features([{"key": n, "kind": "labelled", "grain": "person" if k % 3 == 0 else "record", "value_type": "enum" if k % 3 == 1 else "integer"}])]
            yield pd.DataFrame(rows, columns=["n_nationkey", "problem"])

    return read(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(work, "n_nationkey int, problem string")


@query("derivation_json", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '{"filter":null,"type":"count_objects"}' WHEN 1 THEN '{"filter":{"column":"' || n_name || '","operator":"in","value":["1","2"]},"type":"any_person_matches"}'
 WHEN 2 THEN '{"column":"' || n_name || '","ordered_codes":["b","a"],"table":"objekt","type":"max_ordinal"}' ELSE 'refused' END AS entry FROM nation""")
def derivation_json(spark, sf):
    """Entries read and written again; one of an unknown type, or without its column, is refused."""
    def again(k: int, name: str) -> str:
        entry = [{"type": "count_objects", "filter": None}, {"type": "any_person_matches", "filter": {"value": ["1", "2"], "operator": "in", "column": name}}, {"type": "max_ordinal", "table": "objekt", "column": name, "ordered_codes": ["b", "a"]}, {"type": "distinct_count", "table": "objekt"} if k % 8 == 3 else {"type": "mean"}][k % 4]
        try:
            return derive.derivation_from_json(json.dumps(entry)).to_json()
        except ValueError:
            return "refused"

    @F.pandas_udf("string")
    def entries(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([again(*x) for x in zip(keys, names, strict=True)])

    return read(spark, sf, "nation").select("n_nationkey", entries("n_nationkey", "n_name").alias("entry"))


@query("derive_from_catalogue", "SELECT o_orderkey, CAST(count(l_orderkey) FILTER (WHERE l_returnflag IN ('A', 'N')) AS VARCHAR) AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def derive_from_catalogue(spark, sf):
    spec = derive.derivation_from_json('{"type": "count_objects", "filter": {"column": "l_returnflag", "operator": "in", "value": ["A", "N"]}}')
    return derive.derive(spec, read(spark, sf, "orders"), read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("set_mapping", "SELECT c_mktsegment AS column_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'new' ELSE 'old' END AS attribute FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1")
def set_mapping(spark, sf):
    current = read(spark, sf, "customer").select(F.lit(1).alias("corpus_id"), F.col("c_mktsegment").alias("column_name"), F.lit("old").alias("attribute")).distinct()
    changes = spark.createDataFrame([(1, "BUILDING", "new"), (1, "MACHINERY", "new"), (1, "FURNITURE", None)], "corpus_id int, column_name string, attribute string")
    return codelists.upsert_mapping(current, changes).select("column_name", "attribute")


@query("codelist_snapshot", "SELECT CAST(n_nationkey AS VARCHAR) AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label FROM nation WHERE n_regionkey = 1")
def codelist_snapshot(spark, sf):
    codes = read(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("attribute"), F.col("n_nationkey").cast("string").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("de"), F.col("n_name"))).otherwise(F.create_map(F.lit("fr"), F.col("n_name"))).alias("labels"))
    return codelists.snapshot(codes, "1", "de").select(F.explode("codes").alias("c")).select("c.code", "c.label")


def _function_word_counts() -> str:
    return ", ".join(f"len(list_filter(ws, lambda x: x IN ({', '.join(repr(w) for w in ws)})))::INT AS n_{c}" for c, ws in corpus.FUNCTION_WORDS.items())


_DETECTED = rf"""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'und' WHEN total = 0 OR best::DOUBLE / total < 0.5 THEN 'mixed' WHEN n_de = best THEN 'de' WHEN n_en = best THEN 'en' WHEN n_fr = best THEN 'fr' ELSE 'it' END AS language,
 CASE WHEN trim(coalesce(text, '')) = '' OR total = 0 THEN 0.0 ELSE round(best::DOUBLE / total, 9) END AS confidence FROM (SELECT *, n_de + n_en + n_fr + n_it AS total, greatest(n_de, n_en, n_fr, n_it) AS best
 FROM (SELECT doc_id, text, {_function_word_counts()} FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS ws FROM documents)))"""


@query("detect_language", _DETECTED)
def detect_language(spark, sf):
    found = corpus.detect_language(read(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "language", F.round("confidence", 9).alias("confidence"))


def _frozen(spark, sf):
    """Customers as a delivery: narratives with telephone numbers, one anonymised column, frozen in one step."""
    c = read(spark, sf, "customer")
    key = F.expr("lpad(CAST(c_custkey AS STRING), 32, '0')").alias("record_key")
    records = c.select(key, F.concat(F.lit("Der Mann mit 079 123 45 6"), F.col("c_custkey") % 10, F.lit(" und "), "c_name", F.lit(" … ist in der Stadt")).alias("narrative"), F.lit(False).alias("from_anonymised"))
    cell = lambda column, value: c.select(F.lit("unfall").alias("table_name"), key, F.lit(column).alias("column_name"), value.alias("value_raw"), F.col("c_custkey").cast("long").alias("seq"))
    cells = cell("segment", F.col("c_mktsegment")).union(cell("anonymised", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Tel. 044/123 45 67 "), "c_name")).otherwise("")))
    findings = spark.createDataFrame([("ROW_RECOVERED", None)], "code string, detail map<string,string>")
    out = scratch_dir(spark, "corpus")
    corpus.freeze_delivery(spark, records, cells, findings, out, {"name": "customers"}, anonymised=("anonymised",))
    return out


@query("freeze", """SELECT lpad(CAST(c_custkey AS VARCHAR), 32, '0') AS record_key, 'Der Mann mit <Phone_1> und ' || c_name || ' … ist in der Stadt' AS narrative, 'de' AS language, CASE WHEN c_custkey % 2 = 0 THEN 'Tel. <Phone_1> ' || c_name ELSE '' END AS cell FROM customer""")
def freeze(spark, sf):
    out = _frozen(spark, sf)
    cells = corpus.read_corpus(spark, out, "cell").where("column_name = 'anonymised'").select("record_key", F.col("value_raw").alias("cell"))
    return corpus.read_corpus(spark, out, "record").join(cells, "record_key").select("record_key", "narrative", "language", "cell")


@query("freeze_manifest", """SELECT count(*)::BIGINT AS record_count, count(*)::BIGINT AS canary, count(*)::BIGINT AS german, (count(*) + count(*) FILTER (WHERE c_custkey % 2 = 0))::BIGINT AS phones, 2::BIGINT AS census_rows FROM customer""")
def freeze_manifest(spark, sf):
    out = _frozen(spark, sf)
    facts = spark.read.text(f"{out}/manifest").select(F.from_json("value", "record_count long, cp1252_canary_count long, language_counts map<string,long>").alias("m"))
    phones = corpus.read_corpus(spark, out, "scrub-tally").where("rule_id = 'phone'").select(F.col("hits").alias("phones"))
    census_rows = corpus.read_corpus(spark, out, "census").agg(F.count("*").alias("census_rows"))
    return facts.select("m.record_count", F.col("m.cp1252_canary_count").alias("canary"), F.col("m.language_counts")["de"].alias("german")).join(phones).join(census_rows)


@query(
    "corpus_versions",
    """SELECT v AS version, count(*)::BIGINT AS records, (sum(o_totalprice::DECIMAL(18, 2)) * 100)::BIGINT AS cents, max(count(*)) OVER ()::BIGINT AS latest
 FROM orders, (VALUES (1, 1996), (2, 1999), (3, 2100)) t(v, until) WHERE year(o_orderdate) <= until GROUP BY v""",
)
def corpus_versions(spark, sf):
    """Orders frozen three times as they grow; every version is read again after the last."""
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.year("o_orderdate").alias("year"))
    out = scratch_dir(spark, "corpus")
    none = spark.createDataFrame([], "code string")
    entries = [corpus.freeze(spark, {"record": orders.where(F.col("year") <= until)}, none, out, {"name": "orders"}) for until in (1996, 1999, 2100)]
    latest = corpus.read_corpus(spark, out, "record").agg(F.count("*").alias("latest"))
    versions = [corpus.read_corpus(spark, out, "record", e["version"]).agg(F.count("*").alias("records"), (F.sum("price") * 100).cast("long").alias("cents")).select(F.lit(e["version"]).alias("version"), "records", "cents") for e in entries]
    return functools.reduce(DataFrame.union, versions).join(latest)


# --- exports, written and read back ------------------------------------------------------------------------------------


def _exported(spark, kind: str, rows: DataFrame) -> DataFrame:
    path = f"{scratch_dir(spark, 'export')}/{kind}.csv"
    exports.export(kind, rows, path, "secret", "corpus x")
    return exports.read_csv(spark, kind, path)


@query("census_csv", "SELECT table_name, column_name, CAST(distinct_count AS VARCHAR) AS distinct_count, CASE WHEN long_tail THEN 'True' ELSE 'False' END AS long_tail FROM (" + _CENSUS + ")")
def census_csv(spark, sf):
    rows = _census(spark, sf).withColumns({"type_hint": F.lit("text"), "record_count": F.lit(1), "top_values": F.lit(None).cast("string"), "withheld": F.lit(True)})
    return _exported(spark, "census", rows).select("table_name", "column_name", "distinct_count", "long_tail")


@query("findings_csv", """SELECT CASE o_orderstatus WHEN 'F' THEN '# ORPHAN_FK' WHEN 'P' THEN 'code' ELSE 'ORPHAN_FK' END AS code, CAST(o_orderkey AS VARCHAR) AS key, 'a=' || o_orderpriority || '|b=x;"' || o_orderstatus || '"' AS detail FROM orders""")
def findings_csv(spark, sf):
    detail = F.create_map(F.lit("b"), F.concat(F.lit('x;"'), "o_orderstatus", F.lit('"')), F.lit("a"), F.col("o_orderpriority"))
    rows = read(spark, sf, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN '# ORPHAN_FK' WHEN 'P' THEN 'code' ELSE 'ORPHAN_FK' END").alias("code"), F.lit("blocking").alias("severity"), F.col("o_orderkey").alias("key"), F.lit(None).cast("int").alias("line_no"), detail.alias("detail"))
    return _exported(spark, "findings", rows).select("code", "key", "detail")


def _orders_as(spark, sf, kind: str, **columns) -> DataFrame:
    rows = read(spark, sf, "orders")
    return rows.select(*(columns.get(c, F.lit(None).cast("string")).alias(c) for c in exports.HEADERS[kind]))


@query("presence_csv", "SELECT '#' || o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS anonymised, ' ' || o_orderpriority AS record_value FROM orders")
def presence_csv(spark, sf):
    rows = _orders_as(spark, sf, "presence", record_id=F.concat(F.lit("#"), F.col("o_orderkey").cast("string")), anonymised=F.col("o_orderkey") % 2 == 0, record_value=F.concat(F.lit(" "), "o_orderpriority"))
    return _exported(spark, "presence", rows).select("record_id", "anonymised", "record_value")


@query("mismatches_csv", "SELECT '#' || o_orderkey AS mismatch_id, 'one' || chr(10) || 'two; ' || o_orderstatus AS evidence_span, '' AS note FROM orders")
def mismatches_csv(spark, sf):
    rows = _orders_as(spark, sf, "mismatches", mismatch_id=F.concat(F.lit("#"), F.col("o_orderkey").cast("string")), evidence_span=F.concat(F.lit("one\ntwo; "), "o_orderstatus"))
    return _exported(spark, "mismatches", rows).select("mismatch_id", "evidence_span", "note")


@query("run_scores_csv", "SELECT '# ' || o_orderstatus AS feature_key, CAST(o_orderkey AS VARCHAR) AS n, CAST(o_custkey AS VARCHAR) AS value FROM orders")
def run_scores_csv(spark, sf):
    rows = _orders_as(spark, sf, "run_scores", feature_key=F.concat(F.lit("# "), "o_orderstatus"), n=F.col("o_orderkey"), value=F.col("o_custkey"))
    return _exported(spark, "run_scores", rows).select("feature_key", "n", "value")


@query("run_mismatches_csv", "SELECT '#' || o_orderkey AS mismatch_id, o_orderpriority AS note FROM orders")
def run_mismatches_csv(spark, sf):
    rows = _orders_as(spark, sf, "run_mismatches", mismatch_id=F.concat(F.lit("#"), F.col("o_orderkey").cast("string")), note=F.col("o_orderpriority"))
    return _exported(spark, "run_mismatches", rows).select("mismatch_id", "note")


@query("write_csv", "SELECT '# secret' AS l1, '# corpus x' AS l2, 'r_regionkey;r_name' AS l3, count(*)::BIGINT AS n_rows FROM region")
def write_csv(spark, sf):
    """The parts one after another are the file: mark, comments, header, then the rows."""
    path = f"{scratch_dir(spark, 'export')}/regions.csv"
    exports.write_csv(read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), path, "secret", "corpus x")
    parts = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    whole = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "value"))), lambda x: x["value"]), "").alias("t"))
    lines = F.split(F.replace("t", F.lit("\ufeff"), F.lit("")), "\r\n")
    return whole.select(lines[0].alias("l1"), lines[1].alias("l2"), lines[2].alias("l3"), (F.size(lines) - 4).cast("long").alias("n_rows"))
