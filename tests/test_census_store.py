"""The census of a growing corpus against that of all its cells."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import census
from gleanworks.operators.census_store import CensusStore

CELLS = "table_name string, column_name string, value_raw string, seq long"


def delivery(spark, start, n):
    rows = []
    for i in range(start, start + n):
        rows += [("unfall", "ort", f"o{i % 7}", i), ("unfall", "id", f"id{i}", i), ("unfall", "leer", None if i % 2 else "", i), ("unfall", "rar", "x" if i % 5 == 0 else "", i)]
        if i % 2:
            rows.append(("objekt", "art", str(i % 3), i))
    return spark.createDataFrame(rows, CELLS)


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def whole(spark, cells, records="unfall"):
    values = census.value_table(cells.where("value_raw IS NOT NULL"), F.col("seq"))
    headers = cells.select("table_name", "column_name").distinct()
    n = cells.where(f"table_name = '{records}'").where("column_name = 'ort'").count()
    return values, census.census_columns(values, headers, F.lit(n))


def test_deliveries_one_by_one_give_the_census_of_all(spark, tmp_path):
    store = CensusStore(spark, f"{tmp_path}/s", buckets=4)
    parts = [delivery(spark, 0, 40), delivery(spark, 40, 25), delivery(spark, 65, 3)]
    assert [store.add(p) for p in parts] == [1, 2, 3]
    for version in (1, 2, 3):
        cells = parts[0]
        for p in parts[1:version]:
            cells = cells.union(p)
        values, columns = whole(spark, cells)
        assert rows(store.values(version)) == rows(values)
        assert rows(store.columns("unfall", version).select(columns.columns)) == rows(columns)
    assert rows(census.top_values(store.values(), 3)) == rows(census.top_values(whole(spark, cells)[0], 3))
    assert {r.table_name: r.rows for r in store.rows().collect()} == {"unfall": 68, "objekt": 34}
    before, old = rows(store.columns("unfall")), rows(store.values(2))
    assert store.compact() == 4 and store.compact() == 4
    assert rows(store.columns("unfall")) == before and rows(store.values(2)) == old
    again = CensusStore(spark, f"{tmp_path}/s", buckets=9)
    assert again.buckets == 4 and again.add(delivery(spark, 100, 2)) == 5
    assert {r.table_name: r.rows for r in again.rows().collect()} == {"unfall": 70, "objekt": 35}


def test_the_base_is_not_shuffled(spark, tmp_path):
    store = CensusStore(spark, f"{tmp_path}/s", buckets=4)
    for k in range(3):
        store.add(delivery(spark, 10 * k, 10))
    df = store.values()
    assert df.count() == 41
    plan = df._jdf.queryExecution().executedPlan().toString()
    # from the full join on, the base's side comes first: a sort of bucketed files, no exchange
    base = plan[plan.index("SortMergeJoin") :].split("FileScan")[0]
    assert "Exchange" not in base and "Bucketed: true" in plan, plan


def test_empty_stores_and_deliveries(spark, tmp_path):
    store = CensusStore(spark, f"{tmp_path}/s", buckets=2)
    assert store.values().collect() == store.rows().collect() == store.columns("unfall").collect() == [] and store.compact() == 0
    assert store.add(spark.createDataFrame([], CELLS)) == 1
    assert store.values().collect() == [] and store.columns("unfall").collect() == []
    store.add(spark.createDataFrame([("t", "c", "", 1)], CELLS))
    assert [(r.column_name, r.populated_count, r.bucket) for r in store.columns("t").collect()] == [("c", 0, "empty")]
    with pytest.raises(LookupError):
        store.values(7)


def test_deliveries_at_once_are_all_kept(spark, tmp_path):
    store = CensusStore(spark, f"{tmp_path}/s", buckets=2)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda k: store.add(delivery(spark, 10 * k, 10)), range(4))) == [1, 2, 3, 4]
    assert {r.table_name: r.rows for r in store.rows().collect()} == {"unfall": 40, "objekt": 20}
    assert store.values().where("column_name = 'id'").count() == 40
