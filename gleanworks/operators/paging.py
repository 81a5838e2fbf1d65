"""Pages of long lists by position: rows are stored once in their order, and a page reads the row groups that hold it.

``store`` sorts by range, so no task holds more than its part, and numbers rows within each part; the small index of parts
turns a position of the whole list into one within a part. Positions ascend in the files, so the scan skips all row groups
that a page does not need, however far back it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: what a page reads at least.
ROW_GROUP = 4 << 20
#: Positions within a part are the low bits of ``_at``.
PART = 1 << 33


def store(rows: DataFrame, path: str, order: list[Column], parts: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write ``rows`` in ``order`` (ties as they come: add a key) under ``path``, with the index of its parts."""
    spread = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ordered = spread.sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    ordered.write.option("parquet.block.size", row_group).parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy(F.floor(F.col("_at") / PART).cast("long").alias("part")).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/parts")


def page(spark: SparkSession, path: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """The rows from position ``offset`` on, at most ``limit``, in order, with ``total``; past the end there are none."""
    at, total, ranges = 0, 0, []
    for r in spark.read.parquet(f"{path}/parts").orderBy("part").collect():  # a row for each part
        first, last = max(offset - at, 0), min(offset + limit - at, r.n)
        if first < last:
            ranges.append((r.part * PART + first, r.part * PART + last - 1))
        at += r.n
    total = at
    rows = spark.read.parquet(f"{path}/rows")
    here = F.lit(False)
    for first, last in ranges:
        here = here | F.col("_at").between(first, last)
    return rows.where(here).orderBy("_at").drop("_at").withColumn("total", F.lit(total).cast("long"))
