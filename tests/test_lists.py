"""Overlaps by signature and pages of stored lists."""

import collections
import random

from pyspark.sql import functions as F

from gleanworks.operators import codelists, corpus, integrity, overlap, paging


def test_overlaps_equal_sets(spark):
    rng = random.Random(2)
    left = [(f"c{rng.randrange(12)}", rng.choice([*range(40), None])) for _ in range(900)] + [(None, 1)]
    right = [(f"p{rng.randrange(9)}", rng.randrange(60)) for _ in range(500)]
    sets = lambda rows: {n: {k for m, k in rows if m == n and k is not None} for n in {n for n, _ in rows} if n}
    a, b = sets(left), sets(right)
    expected = {(x, y): len(a[x] & b[y]) for x in a for y in b if a[x] & b[y]}
    frame = lambda rows: spark.createDataFrame(rows, "name string, k int").repartition(3)
    assert {(r.l, r.r): r.overlap for r in overlap.overlaps(frame(left), frame(right)).collect()} == expected
    assert overlap.overlaps(frame(left).where("false"), frame(right)).collect() == []


def test_a_code_in_two_thousand_columns(spark):
    """Codes that lie in the same columns are one row before pairs are made: 2000 columns and 40 lists meet 25 000 times on 50
    codes of which there are but two kinds."""
    columns = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("code"))
    values = columns.select("column", F.col("code").cast("string").alias("value")).unionByName(spark.createDataFrame([("c7", "x")], "column string, value string"))
    codes = spark.range(40).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("attribute"), F.explode(F.sequence(F.lit(0), F.lit(49) + F.col("id").cast("int"))).alias("code")).select("attribute", F.col("code").cast("string").alias("code"))
    met = overlap.signatures(values.select(F.col("column").alias("name"), F.col("value").alias("k")), codes.select(F.col("attribute").alias("name"), F.col("code").alias("k"))).collect()
    assert [(len(r.lefts), len(r.rights), r.n) for r in met] == [(2000, 40, 50)]
    found = codelists.mapping_suggest(values, codes)
    assert found.count() == 1999 and {r.attribute for r in found.select("attribute").distinct().collect()} == {"a0"}


def test_sets_of_files_that_share_keys(spark):
    child = spark.createDataFrame([("o1", 1), ("o1", 2), ("o2", 2), ("o2", None), ("o3", 9), ("o4", None)], "file string, k int")
    parent = spark.createDataFrame([("u1", 1), ("u1", 2), ("u0", 2), ("u2", 1)], "pf string, pk int")
    assert {r.file: (r.set, r.overlap) for r in integrity.resolve_sets(child, parent, "file", "k", "pf", "pk").collect()} == {"o1": ("u1", 2), "o2": ("u0", 1), "o3": (None, 0), "o4": (None, 0)}


def scanned(df):
    """Rows that the scan of the stored list gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    counts = collections.Counter()

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name.startswith("Scan parquet"):
            counts["rows"] += p.metrics().apply("numOutputRows").value()
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    return counts["rows"]


def test_a_page_far_back_reads_two_row_groups(spark, tmp_path):
    rows = spark.range(600_000).select(F.col("id").alias("key"), (F.xxhash64("id") % 1000).alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    order = [F.desc("size"), F.col("key")]
    paging.store(rows, f"{tmp_path}/list", order, parts=3, row_group=1 << 20)
    page = paging.page(spark, f"{tmp_path}/list", 500_000, 50)
    plain = corpus.page(rows, "size", "key", descending=True, offset=500_000, limit=50)
    assert page.columns == plain.columns and [tuple(r) for r in page.collect()] == [tuple(r) for r in plain.collect()]
    import pyarrow.parquet as pq

    groups = [g for f in (tmp_path / "list" / "rows").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(k).num_rows for k in range(m.num_row_groups)]]
    assert len(groups) > 20 and scanned(page) <= 2 * max(groups)


def test_pages_of_short_lists(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 2) for k in range(10)], "key int, size int")
    for name, df in (("some", rows), ("none", rows.where("false"))):
        paging.store(df, f"{tmp_path}/{name}", [F.col("size").asc_nulls_last(), F.col("key")])
        for offset in (0, 7, 9, 10, 99):
            expected = [tuple(r) for r in corpus.page(df, "size", "key", offset=offset, limit=4, nulls_last=True).collect()]
            assert [tuple(r) for r in paging.page(spark, f"{tmp_path}/{name}", offset, 4).collect()] == expected
