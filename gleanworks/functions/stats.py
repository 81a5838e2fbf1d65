"""Wilson intervals, suppression, ties and macro averages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution as used for all intervals.
Z = 1.959963985
MIN_COUNT = 20


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """(low, high) of the Wilson score interval, within 0 and 1; without cases it is (0, 1)."""
    k, m = successes.cast("double"), n.cast("double")
    p, z2 = k / m, Z * Z
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = Z / (1 + z2 / m) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    low = F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    return low, F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def suppress(value: Column, n: Column, floor: int = MIN_COUNT) -> Column:
    """The value, or null where fewer than ``floor`` cases stand behind it."""
    return F.when(n >= floor, value)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mark_ties(rows: DataFrame, feature: str = "feature", model: str = "model", point: str = "point", low: str = "low", high: str = "high") -> DataFrame:
    """``rows`` with mark: the leader of a feature is best, or tied with every model whose interval meets its own.

    The leader is the highest point, of equal points the first model. Intervals are closed: touching is meeting. A row
    without a point has no mark.
    """
    per = Window.partitionBy(feature)
    ranked = per.orderBy(F.col(point).desc_nulls_last(), F.col(model))
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = rows.withColumn("_lead", F.first(F.struct(F.col(model).alias("m"), F.col(low).alias("lo"), F.col(high).alias("hi"))).over(whole))
    meets = F.col(point).isNotNull() & (F.col(model) != F.col("_lead.m")) & (F.col(low) <= F.col("_lead.hi")) & (F.col(high) >= F.col("_lead.lo"))
    counted = lead.withColumn("_meets", meets).withColumn("_n", F.count_if("_meets").over(per))
    is_lead = F.col(point).isNotNull() & (F.col(model) == F.col("_lead.m"))
    mark = F.when(is_lead & (F.col("_n") == 0), "best").when(is_lead | F.col("_meets"), "tied").otherwise("none")
    return counted.withColumn("mark", mark).drop("_lead", "_meets", "_n")


def macro_interval(cells: DataFrame, by: str = "model", point: str = "point", low: str = "low", high: str = "high", n: str = "n") -> DataFrame:
    """Per group: mean of the points, and an interval round the mean of the mid-points with the combined standard error."""
    half = (F.col(high) - F.col(low)) / 2 / Z
    middle = F.avg((F.col(low) + F.col(high)) / 2)
    spread = Z * F.sqrt(F.sum(half * half)) / F.count(F.lit(1))
    return cells.groupBy(by).agg(
        F.avg(point).alias("macro"), F.greatest(F.lit(0.0), middle - spread).alias("macro_low"), F.least(F.lit(1.0), middle + spread).alias("macro_high"), F.sum(n).cast("long").alias("n"), F.count(F.lit(1)).alias("n_features")
    )


def exact_round(x: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals from its exact value, ties to even, as a double.

    The product with the power of ten is split into what a double holds and the exact rest, which decides where the product
    alone looks like a tie. Holds for up to 11 decimals and products below 2^53; null, NaN and infinity stay.
    """
    if not 0 <= digits <= 11:
        raise ValueError("0 to 11 digits")
    scale = F.lit(10.0**digits)
    big = x * F.lit(134217729.0)  # 2^27 + 1 cuts a double into halves
    high = big - (big - x)
    low = x - high
    power_big = scale * F.lit(134217729.0)
    power_high = power_big - (power_big - scale)
    power_low = scale - power_high
    product = x * scale
    rest = ((high * power_high - product) + high * power_low + low * power_high) + low * power_low
    down = F.floor(product).cast("double")
    side = (product - down) - F.lit(0.5)
    up = (side > 0) | (side == 0) & ((rest > 0) | (rest == 0) & (down % 2 != 0))
    whole = F.when(up, down + 1).otherwise(down)
    return F.when(F.abs(x) < F.lit(2.0**53) / scale, whole / scale).otherwise(x)
