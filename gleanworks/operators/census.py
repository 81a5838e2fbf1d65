"""Column census: population, distinct values, most frequent values, type hints and buckets of every column.

Values are counted with map-side combine, so what is shuffled is the distinct values of each column and task, not the cells.
A wide table is counted column by column, each as the numbers or dates that it holds, and distinct values alone are spelt.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 20
LONG_TAIL_SHARE = 0.01
#: Column name endings of coded columns, and the buckets with their upper bounds (closed above).
ENUM_SUFFIXES = ("Ausw", " UAP")
BUCKETS = (("empty", None), ("0-20", 0.2), ("20-50", 0.5), ("50-80", 0.8), ("80-99", 0.99), ("99-100", None))
GROUPED = r"^-?\d{1,3}(?:'\d{3})*(?:\.\d+)?$"


def as_text(df: DataFrame) -> DataFrame:
    """All columns as strings, doubles by way of decimals, so that a value has one spelling in every engine."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*((F.col(f.name).cast("decimal(18,2)") if isinstance(f.dataType, floating) else F.col(f.name)).cast("string").alias(f.name) for f in df.schema))


def melt_cells(df: DataFrame, table: str, key: str) -> DataFrame:
    """Cells (table_name, row_key, column_name, value_raw) of every column; missing values are empty strings."""
    cols = df.columns
    wide = as_text(df).withColumn("row_key", F.col(key).cast("string"))
    cells = wide.unpivot("row_key", [F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols], "column_name", "value_raw")
    return cells.select(F.lit(table).alias("table_name"), "row_key", "column_name", "value_raw")


def value_table(cells: DataFrame, sequence: Column) -> DataFrame:
    """Distinct populated values: table_name, column_name, value_raw, n, first (the smallest sequence number)."""
    return cells.where("value_raw <> ''").groupBy("table_name", "column_name", "value_raw").agg(F.count("*").alias("n"), F.min(sequence).alias("first"))


#: Types whose distinct values have distinct spellings.
_SPELT_APART = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.StringType)


def column_counts(df: DataFrame, table: str, key: str) -> list[DataFrame]:
    """The value table of ``melt_cells(df, table, key)`` in the sequence of the key, a part for each column, without a row or
    a text for each cell."""
    cells = []
    for f in df.schema:
        value, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value, kind = value.cast("decimal(18,2)"), T.DecimalType(18, 2)
        counted = df.select(value.alias("v"), F.col(key).try_cast("long").alias("s")).groupBy("v").agg(F.count("*").alias("n"), F.min("s").alias("first"))
        spelt = counted.select(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.col("v").cast("string").alias("value_raw"), "n", "first").where("value_raw <> ''")
        if not isinstance(kind, _SPELT_APART):
            spelt = spelt.groupBy("table_name", "column_name", "value_raw").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        cells.append(spelt)
    return cells


def top_of_columns(columns: list[DataFrame], k: int = TOP) -> DataFrame:
    """``top_values`` of a value table in parts of one column each: a task holds k values, and sorts none of the others.

    Totals ask for the first place too, which no rank is before, so that they and the ranks read the same counts and these
    are made once.
    """
    order = [F.desc("n"), F.asc("first"), F.asc("value_raw")]
    best = functools.reduce(DataFrame.unionAll, [c.orderBy(*order).limit(k) for c in columns])
    total = functools.reduce(DataFrame.unionAll, columns).groupBy("table_name", "column_name").agg(F.sum("n").alias("total"), F.min("first").alias("_first"))
    ranked = best.withColumn("value_rank", F.row_number().over(Window.partitionBy("table_name", "column_name").orderBy(*order)))
    known = ranked.join(total, ["table_name", "column_name"]).where("first IS NULL OR first >= _first")
    return known.select("table_name", "column_name", "value_rank", "value_raw", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def census_columns(values: DataFrame, headers: DataFrame, record_count: Column) -> DataFrame:
    """Per column of ``headers(table_name, column_name)``: populated_count, populated_rate, distinct_count,
    top_value_share, long_tail, bucket. The rate is per accident in every table, so a child's may exceed 1."""
    counted = values.groupBy("table_name", "column_name").agg(F.sum("n").alias("populated_count"), F.count("*").alias("distinct_count"), F.max("n").alias("top"))
    joined = headers.join(counted, ["table_name", "column_name"], "left").fillna(0, ["populated_count", "distinct_count", "top"])
    share = F.coalesce(F.try_divide(F.col("top").cast("double"), F.col("populated_count").cast("double")), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.col("populated_count").cast("double"), record_count.cast("double")), F.lit(0.0))
    out = joined.withColumns({"populated_rate": F.round(rate, 9), "top_value_share": F.round(share, 9), "long_tail": (F.col("distinct_count") > TOP) & (share < LONG_TAIL_SHARE)})
    return out.withColumn("bucket", bucket(F.col("populated_count"), rate)).drop("top")


def top_values(values: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent values of each column, of equal counts the first seen: value_rank, value_raw, n, share.

    Counting is over before ranking, so a task holds the distinct values of its columns at most; the rank filter is
    pushed below the shuffle, where each task keeps k values a column.
    """
    order = Window.partitionBy("table_name", "column_name").orderBy(F.desc("n"), "first", "value_raw")
    total = values.groupBy("table_name", "column_name").agg(F.sum("n").alias("total"))
    ranked = values.withColumn("value_rank", F.row_number().over(order)).where(F.col("value_rank") <= k)
    return ranked.join(total, ["table_name", "column_name"]).select("table_name", "column_name", "value_rank", "value_raw", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def bucket(populated: Column, rate: Column) -> Column:
    out = F.when(populated == 0, "empty")
    for label, upper in BUCKETS[1:]:
        out = out.otherwise(label) if upper is None else out.when(rate <= upper, label)
    return out


def bucket_counts(columns: DataFrame) -> DataFrame:
    """Columns per bucket, buckets without columns included: bucket, n."""
    labels = columns.sparkSession.createDataFrame([(b,) for b, _ in BUCKETS], "bucket string")
    return labels.join(columns.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").fillna(0, ["n"])


def _plausible_date(v: Column) -> Column:
    year = F.when(v.rlike(r"^\d{8}$"), F.substring(v, 1, 4).try_cast("int")).when(v.rlike(r"^\d{2}\.\d{2}\.\d{2}$"), F.substring(v, 7, 2).try_cast("int") + F.when(F.substring(v, 7, 2).try_cast("int") <= 68, 2000).otherwise(1900))
    month = F.when(v.rlike(r"^\d{8}$"), F.substring(v, 5, 2)).otherwise(F.substring(v, 4, 2)).try_cast("int")
    day = F.when(v.rlike(r"^\d{8}$"), F.substring(v, 7, 2)).otherwise(F.substring(v, 1, 2)).try_cast("int")
    return F.coalesce(year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31), F.lit(False))


def _numeric(v: Column) -> tuple[Column, Column]:
    """(integer, decimal): what Python's int() and float() read, after grouping apostrophes of the exact shape go."""
    bare = F.when(v.rlike(GROUPED), F.translate(v, "'", "")).otherwise(v)
    whole = bare.rlike(r"(?U)^\s*[+-]?\d+(?:_\d+)*\s*$")
    digits = r"\d+(?:_\d+)*"
    return whole, whole | bare.rlike(rf"(?iU)^\s*[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf(?:inity)?|nan)\s*$")


def type_hints(values: DataFrame, headers: DataFrame) -> DataFrame:
    """table_name, column_name, type_hint of every header column, judged on its distinct values."""
    v = F.col("value_raw")
    whole, decimal = _numeric(v)
    all_of = lambda test, name: F.bool_and(F.coalesce(test, F.lit(False))).alias(name)
    shapes = values.groupBy("table_name", "column_name").agg(all_of(_plausible_date(v), "d"), all_of(v.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "t"), all_of(whole, "i"), all_of(decimal, "f"), F.sum("n").alias("n"))
    coded = functools.reduce(lambda a, b: a | b, (F.col("column_name").endswith(s) for s in ENUM_SUFFIXES))
    # The count is asked for so that shapes are tested once for each distinct value, not for each cell.
    hint = F.when(coded, "enum").when(F.col("n").isNull(), "text").when(F.col("d"), "date").when(F.col("t"), "time").when(F.col("i"), "integer").when(F.col("f"), "decimal").otherwise("text")
    return headers.join(shapes, ["table_name", "column_name"], "left").select("table_name", "column_name", hint.alias("type_hint"))


def with_samples(columns: DataFrame, tops: DataFrame) -> DataFrame:
    """Census rows with top_values, shown for coded columns only; withheld says that there are values not shown."""
    per = tops.groupBy("table_name", "column_name").agg(F.sort_array(F.collect_list(F.struct("value_rank", "value_raw", "n", "share"))).alias("t"))
    joined = columns.join(per, ["table_name", "column_name"], "left")
    shown = F.col("type_hint") == "enum"
    return joined.withColumns({"top_values": F.when(shown, F.col("t")), "withheld": ~shown & F.coalesce(F.size("t") > 0, F.lit(False))}).drop("t")


def census_page(columns: DataFrame, table: str | None = None, min_rate: float = 0.0, sort: str = "populated_rate", descending: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of census rows with ``total``, the rows of all pages; an unknown sort key is the populated rate."""
    rows = columns.where(F.col("populated_rate") >= min_rate)
    if table:
        rows = rows.where(F.col("table_name") == table)
    key = F.col(sort if sort in columns.columns else "populated_rate")
    rows = rows.join(rows.agg(F.count("*").alias("total")))
    rows = rows.orderBy(key.desc() if descending else key.asc(), "table_name", "column_name").offset(offset)
    return rows.limit(limit) if limit is not None else rows


def census_summary(columns: DataFrame) -> DataFrame:
    """Columns per table and in all (table_name '*')."""
    return columns.groupBy("table_name").agg(F.count("*").alias("n_columns")).union(columns.agg(F.lit("*").alias("table_name"), F.count("*").alias("n_columns")))


def census_in_config(columns: DataFrame, features: DataFrame) -> DataFrame:
    """Census rows with in_config: some feature names the column as its source."""
    named = features.select(F.col("source_column").alias("column_name")).where("column_name IS NOT NULL").distinct().withColumn("in_config", F.lit(True))
    return columns.join(named, "column_name", "left").fillna(False, ["in_config"])
