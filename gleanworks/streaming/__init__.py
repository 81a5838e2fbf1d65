"""Answers as a stream: each record is parsed and appended once, however often the query restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import parsed

ANSWERS = "run_id string, record_id string, raw string, answered_at timestamp"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of answers as they arrive in a folder."""
    return spark.readStream.schema(ANSWERS).json(path)


def parsed_answers(answers: DataFrame, features: list[tuple[str, str]], late: str = "1 day") -> DataFrame:
    """(run_id, record_id, answered_at, failure, values, issues), repeated answers within the watermark dropped."""
    once = answers.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["run_id", "record_id"])
    return once.select("run_id", "record_id", "answered_at", parsed("raw", features).alias("p")).select("run_id", "record_id", "answered_at", "p.failure", "p.values", "p.issues")


def progress(answers: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Answers per run and window, emitted when the watermark has passed."""
    return answers.withWatermark("answered_at", late).groupBy("run_id", F.window("answered_at", window).alias("w")).agg(F.count("*").alias("n"))


def write_extractions(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet partitioned by run; all that is there now, then stop. The checkpoint makes it exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("run_id").outputMode("append").trigger(availableNow=True).start()
