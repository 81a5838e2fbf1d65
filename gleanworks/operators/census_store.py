"""The census of a growing corpus: value counts stored by delivery, bucketed alike, merged bucket by bucket.

Adding a delivery reads and writes that delivery alone. What the census needs of all deliveries, their merged value counts,
is one pass over stored distinct values, and no delivered cell is read again: the base, a bucketed table, stays where it is,
and the counts of what was added since are summed and sent to its buckets. ``compact`` makes all of them the new base.

The store's list of deliveries is a log of versions, each claimed by one writer (see ``corpus.commit``): two deliveries
added at once are both kept, a reader sees one version, and a delivery that fails half-way is in none.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import census, corpus

KEYS = ("table_name", "column_name", "value_raw")
VALUES = "table_name string, column_name string, value_raw string, n long, first long"
ROWS = "table_name string, rows long"


class CensusStore:
    """Value counts of all deliveries in the folder ``path``, which driver and executors share.

    ``buckets`` is fixed by the first delivery; a bucket of the merged counts is the work of one task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path = spark, path
        known = self._known()
        self.buckets = known["buckets"] if known else buckets

    def _known(self, version: int | None = None) -> dict | None:
        try:
            return corpus.snapshot(self.spark, self.path, version)
        except LookupError:
            if version is not None:
                raise
            return None

    def _write(self, values: DataFrame, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}/rows")
        name = f"census_{part.replace('-', '_')}"
        dealt = values.select(*KEYS, "n", "first").repartition(self.buckets, *KEYS)
        dealt.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.path}/{part}/values").format("parquet").saveAsTable(name)
        return part

    def _bucketed(self, part: str) -> DataFrame:
        """A part's counts, known to the session as a bucketed table."""
        name = f"census_{part.replace('-', '_')}"
        keys = ", ".join(KEYS)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({VALUES}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part}/values'")
        return self.spark.table(name)

    def add(self, cells: DataFrame, sequence: str = "seq") -> int:
        """Add a delivery's ``cells(table_name, column_name, value_raw, sequence)``; the store's new version.

        Sequence numbers order values of equal counts, so a later delivery's should be higher. A null value is missing like
        an empty one. A column whose cells are all empty stays a column, and a delivery without rows is a version, too.
        """
        c = cells.select("table_name", "column_name", F.coalesce("value_raw", F.lit("")).alias("value_raw"), F.col(sequence).cast("long").alias("seq"))
        # An empty value stands for the column, with a count of its empty cells.
        counted = c.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        per_column = cells.groupBy("table_name", "column_name").agg(F.count("*").alias("cells"))
        part = self._write(counted, per_column.groupBy("table_name").agg(F.max("cells").alias("rows")))
        return self._listed([], part)

    def _listed(self, merged: list[str], part: str) -> int:
        """A version with ``part`` added, or in the place of those that it is merged from, whatever others add meanwhile."""

        def following(last: dict | None) -> dict | None:
            parts = last["parts"] if last else []
            if last and last["buckets"] != self.buckets:
                raise ValueError(f"the store has {last['buckets']} buckets")
            if not set(merged) <= set(parts):
                return None
            rest = [p for p in parts if p not in merged]
            return {"buckets": self.buckets, "parts": [part, *rest] if merged else [*rest, part]}

        entry = corpus.commit_next(self.spark, self.path, following)
        return entry["version"] if entry else corpus.snapshot(self.spark, self.path)["version"]

    def values(self, version: int | None = None, missing: bool = False) -> DataFrame:
        """The merged counts of a version, the last by default, as ``census.value_table`` gives them; ``missing`` keeps
        the empty value of each column that has one. An empty store has none."""
        known = self._known(version)
        if not known:
            return self.spark.createDataFrame([], VALUES)
        wanted = (lambda df: df) if missing else lambda df: df.where("value_raw <> ''")
        base, *added = known["parts"]
        base = wanted(self._bucketed(base))
        if not added:
            return base
        added = [wanted(self.spark.read.schema(VALUES).parquet(f"{self.path}/{p}/values")) for p in added]
        new = functools.reduce(DataFrame.unionAll, added).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # hashed as the base is, so that the base is not sent anywhere
        new = new.repartition(self.buckets, *KEYS)
        b, a = base.hint("merge").alias("b"), new.alias("a")
        both = b.join(a, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in KEYS], "full")
        either = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        n = F.coalesce("b.n", F.lit(0)) + F.coalesce("a.n", F.lit(0))
        return both.select(*(either(k) for k in KEYS), n.alias("n"), F.least("b.first", "a.first").alias("first"))

    def rows(self, version: int | None = None) -> DataFrame:
        """table_name, rows: how many rows each table has in all deliveries (cells of its fullest column)."""
        known = self._known(version)
        if not known:
            return self.spark.createDataFrame([], ROWS)
        each = [self.spark.read.schema(ROWS).parquet(f"{self.path}/{p}/rows") for p in known["parts"]]
        return functools.reduce(DataFrame.unionAll, each).groupBy("table_name").agg(F.sum("rows").alias("rows"))

    def columns(self, records: str, version: int | None = None) -> DataFrame:
        """The census of columns of a version; rates are per row of the table ``records``."""
        known = self._known(version)
        at = known["version"] if known else None
        headers = self.values(at, missing=True).select("table_name", "column_name").distinct()
        n = self.rows(at).where(F.col("table_name") == records).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_records"))
        return census.census_columns(self.values(at), headers.join(n), F.col("_records")).drop("_records")

    def compact(self) -> int:
        """One base of all that the store lists now; the store's version. Parts added meanwhile stay; if another writer has
        compacted meanwhile, that one's work stands."""
        known = self._known()
        if not known or len(known["parts"]) < 2:
            return known["version"] if known else 0
        part = self._write(self.values(known["version"], missing=True), self.rows(known["version"]))
        return self._listed(known["parts"], part)
