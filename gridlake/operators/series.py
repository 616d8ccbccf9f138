"""Windows along time or any other order: rolling statistics and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, value: str, partition: list[str], order: list[str], width: int, statistic: str = "mean", ignore: float | None = None, weights: list[float] | None = None, out: str | None = None) -> DataFrame:
    """A statistic of the values around each row, nulls and ``ignore`` left out: mean, median, min, max, sum, slope
    (of the row and the next ``width`` - 1, null at the end) or convolve (with ``weights``, null at both ends)."""
    half = width // 2
    by = Window.partitionBy(*partition).orderBy(*order)
    around = by.rowsBetween(-half, half)
    v = F.col(value) if ignore is None else F.when(F.col(value) != ignore, F.col(value))
    if statistic == "slope":
        ahead = by.rowsBetween(0, width - 1)
        numbered = df.withColumn("__t", F.row_number().over(by))
        made = F.when(F.count(F.lit(1)).over(ahead) == width, F.regr_slope(v, F.col("__t")).over(ahead))
        return numbered.withColumn(out or "slope", made).drop("__t")
    if statistic == "convolve":
        w = weights or [1.0] * width
        xs = F.collect_list(F.coalesce(v, F.lit(0.0))).over(around)
        made = F.when(F.size(xs) == len(w), F.aggregate(F.zip_with(xs, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    elif statistic == "median":
        made = F.percentile(v, 0.5).over(around)
    else:
        made = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[statistic](v).over(around)
    return df.withColumn(out or statistic, made)


def interpolate(df: DataFrame, value: str, partition: list[str], order: str, missing: float | None = 0.0, out: str | None = None) -> DataFrame:
    """Missing values on the line between their valid neighbours, by position; beyond the ends the nearest valid one.

    A partition without a value over 0 stays as it is."""
    by = Window.partitionBy(*partition).orderBy(order)
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    v = F.col(value).cast("double")
    good = v if missing is None else F.when(v != missing, v)
    at = F.when(good.isNotNull(), F.col("__t"))
    df = df.withColumn("__t", F.row_number().over(by))
    cols = {"__a": F.last(good, True).over(before), "__b": F.first(good, True).over(after), "__ta": F.last(at, True).over(before), "__tb": F.first(at, True).over(after)}
    step = F.when(F.col("__tb") > F.col("__ta"), (F.col("__b") - F.col("__a")) * (F.col("__t") - F.col("__ta")) / F.when(F.col("__tb") > F.col("__ta"), F.col("__tb") - F.col("__ta"))).otherwise(0.0)
    line = F.coalesce(F.col("__a") + step, F.col("__a"), F.col("__b"))
    some = F.max(v).over(Window.partitionBy(*partition)) > 0
    made = F.when(some, F.coalesce(good, line)).otherwise(v)
    return df.withColumns(cols).withColumn(out or f"{value}_filled", made).drop("__t", *cols)
