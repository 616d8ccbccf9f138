"""Class maps: reclassifying, recoding, change, histograms, majorities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reclassify(value: Column, table: dict[int, int]) -> Column:
    """All rules at once, each on the original value; values without a rule stay."""
    if not table:
        return value
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value.cast("int")], value.cast("int"))


def recode(df: DataFrame, value: str, zone: str, rules: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Rules of each zone one after the other, each on the value that the last left."""
    out: Column = F.col(value)
    steps = max(map(len, rules.values()), default=0)
    for k in range(steps):
        now, nxt = out, out
        for z, table in rules.items():
            if k < len(table):
                old, new = table[k]
                nxt = F.when((F.col(zone) == z) & (now == old), F.lit(new)).otherwise(nxt)
        out = nxt
    return df.withColumn(value, out)


def change_map(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """``pairs`` with ``change``: numbers from 1, row by row of the matrix of ``before``'s sorted classes."""
    classes = pairs.select(F.col(before).alias("c")).distinct().withColumn("k", F.row_number().over(Window.orderBy("c")))
    n = classes.count()
    a, b = (classes.select(F.col("c").alias(f"__c{x}"), F.col("k").alias(f"__k{x}")) for x in "ab")
    out = pairs.join(F.broadcast(a), F.col(before) == F.col("__ca"), "left").join(F.broadcast(b), F.col(after) == F.col("__cb"), "left")
    return out.withColumn("change", (F.col("__ka") - 1) * n + F.col("__kb")).drop("__ca", "__cb", "__ka", "__kb")


def change_matrix(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(from_class, to_class, change, count) for every pair of ``before``'s classes, 0 where none changed so.

    Counting is partial on every task; the class list is one small aggregate."""
    counts = pairs.groupBy(F.col(before).alias("from_class"), F.col(after).alias("to_class")).agg(F.count(F.lit(1)).alias("count"))
    classes = sorted(r[0] for r in pairs.select(before).distinct().collect() if r[0] is not None)
    kind = dict(pairs.dtypes)[before]
    grid = pairs.sparkSession.createDataFrame([(a, b, i * len(classes) + j + 1) for i, a in enumerate(classes) for j, b in enumerate(classes)], f"from_class {kind}, to_class {kind}, change bigint")
    return grid.join(counts, ["from_class", "to_class"], "left").select("from_class", "to_class", "change", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, count, percent) of non-empty bins over [low, high], by default 0 to bins - 1; the last bin holds ``high``.

    Percent is of the cells that aren't in bin 0 where the range starts at 0, else of all."""
    low, high = 0.0 if low is None else low, float(bins - 1) if high is None else high
    at = F.least(F.floor((F.col(value) - low) * (bins / (high - low))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    counted = F.col("count") if low != 0 else F.when(F.col("bin") != 0, F.col("count"))
    total = F.sum(counted).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.when(total > 0, counted * 100.0 / F.when(total > 0, total)))


def match_histogram(df: DataFrame, reference: DataFrame, value: str, bins: int = 254, low: float = 1.0, high: float = 255.0) -> DataFrame:
    """Values moved so that their distribution follows the reference's; zeros stay.

    Both cumulative histograms are small tables; a value goes to its share, and the share to the reference's value,
    each by linear interpolation."""

    def cumulated(d):
        rows = histogram(d.where(F.col(value) != 0), value, bins, low, high).select("bin", "count").orderBy("bin").collect()
        got = {r["bin"]: r["count"] for r in rows}
        out, run = [], 0
        for b in range(bins):
            run += got.get(b, 0)
            out.append(float(run))
        return [x / run * 255 for x in out] if run else out

    step = (high - low) / bins
    edges = [low + step * k for k in range(bins)]
    own, ref = cumulated(df), cumulated(reference)
    kept = [k for k in range(bins) if k == 0 or ref[k] > ref[k - 1]]

    if not own or not ref:
        return df.withColumn("matched", F.col(value).cast("double"))
    levels, marks = [ref[k] for k in kept], [edges[k] for k in kept]

    @F.pandas_udf("double")
    def moved(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(np.interp(x.to_numpy(float), edges, own), levels, marks))

    return df.withColumn("matched", F.when(F.col(value) != 0, moved(F.col(value).cast("double"))).otherwise(0.0))


def majority(votes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each key, of several the least; counting is partial on every task."""
    counts = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(label)).alias("m"))).alias("x")).select(*keys, (-F.col("x.m")).alias("majority"), F.col("x.n").alias("votes"))
