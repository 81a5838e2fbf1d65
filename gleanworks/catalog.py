"""The registry of queries: a name, a DataFrame builder over (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``sql`` runs on DuckDB views of the same tables."""

    def register(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = builder
        if sql:
            ORACLES[name] = sql
        return builder

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; without that setting, in local mode, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gleanworks-')}"
    return f"{base.rstrip('/')}/gleanworks-{what}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks: few columns of a small file are one task however many rows they are, and however much work
    each of them makes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
