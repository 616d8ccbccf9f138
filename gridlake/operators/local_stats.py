"""Statistics of one cell over its bands or dates, inside each row: array functions and array kernels, no shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridlake.functions.numeric import ratio


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean(x: Column) -> Column:
    return ratio(_total(x), F.size(x))


def _variance(x: Column) -> Column:
    """Of the population; null for no values."""
    m = _mean(x)
    return _mean(F.transform(x, lambda v: (v - m) * (v - m)))


def percentile(x: Column, p: float, ordered: bool = False) -> Column:
    """Linear interpolation between the sorted values; ``ordered``: they are sorted already."""
    s = x if ordered else F.array_sort(x)
    at = (F.size(x) - 1) * (p / 100.0)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(low + 2, F.size(x)))
    return F.when(F.size(x) > 0, a + (b - a) * (at - low))


def mode(x: Column) -> Column:
    """The most frequent value, of several the least."""
    counts = F.transform(F.array_distinct(x), lambda u: F.struct(F.size(F.filter(x, lambda v: v == u)).alias("n"), (-u).alias("m")))
    return -F.array_max(counts)["m"]


STATISTICS = {
    "min": F.array_min,
    "max": F.array_max,
    "mean": _mean,
    "median": lambda x: percentile(x, 50),
    "mode": mode,
    "var": _variance,
    "std": lambda x: F.sqrt(_variance(x)),
    "cv": lambda x: ratio(F.sqrt(_variance(x)), _mean(x)),
    "sum": lambda x: F.when(F.size(x) > 0, _total(x)),
}


def pixel_stat(df: DataFrame, bands: str, statistic: str, out: str | None = None, ignore: float | None = None, no_data: float = 0.0, below: float | None = None, above: float | None = None, common: int | None = None) -> DataFrame:
    """A statistic over the array column ``bands``, nulls and ``ignore`` left out.

    Results under ``below`` or over ``above`` become ``no_data``, and so does the statistic of no values; with
    ``common``, so do rows in which fewer than that many values equal the mode."""
    x = F.filter(bands, lambda v: v.isNotNull() & ~F.isnan(v) & (F.lit(True) if ignore is None else v != ignore))
    value = STATISTICS[statistic](x)
    if below is not None:
        value = F.when(value >= below, value)
    if above is not None:
        value = F.when(value <= above, value)
    if common is not None:
        m = mode(x)
        value = F.when(F.size(F.filter(x, lambda v: v == m)) >= common, value)
    return df.withColumn(out or statistic, F.coalesce(value, F.lit(no_data)))


def zscores(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Each column less its mean, by its population deviation, over all rows; 0 where that is 0."""
    made = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    cols = {}
    for c in columns:
        m, s = made[f"m_{c}"] or 0.0, made[f"s_{c}"] or 0.0
        cols[c + suffix] = (F.col(c) - m) / s if s else F.lit(0.0)
    return df.withColumns(cols)


# features of a series in date order

PERCENTILES = {"five": 5, "twenty_five": 25, "fifty": 50, "seventy_five": 75, "ninety_five": 95}
WIDTH = 15  # values of a slope's window


def _rolling_slopes(x: np.ndarray) -> np.ndarray:
    """Least-squares slopes of all windows of ``WIDTH`` values of each row."""
    t = np.arange(WIDTH) - (WIDTH - 1) / 2
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1) @ t / (t @ t)


def _deviation_share(x: np.ndarray) -> np.ndarray:
    m = x.mean(1)
    return np.where(m != 0, x.std(1) / np.where(m != 0, m, 1), 0.0)


#: Name -> (fewest values, function of a matrix with a series in each row, all of one length).
FEATURES = {
    "mean": (1, lambda x: x.mean(1)),
    "cv": (1, _deviation_share),
    **{n: (1, (lambda p: lambda x: np.percentile(x, p, axis=1))(p)) for n, p in PERCENTILES.items()},
    **{f"{n}_cumulative": (1, (lambda p: lambda x: x[:, : min(math.ceil(x.shape[1] * (p / 100.0)), x.shape[1] - 1) + 1].sum(1))(p)) for n, p in PERCENTILES.items()},
    "min_slope": (WIDTH, lambda x: _rolling_slopes(x).min(1)),
    "max_slope": (WIDTH, lambda x: _rolling_slopes(x).max(1)),
    "max_diff": (3, lambda x: np.abs(x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]).max(1)),
}


def _feature_pass(series: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.names.index(series))
            col = col.cast(pa.list_(pa.float64()))
            size = pc.fill_null(col.value_lengths(), 0).to_numpy()
            values = col.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(size)[:-1]].astype(int)
            made = {n: np.full(b.num_rows, np.nan) for n in names}
            for k in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == k)
                x = values[start[own][:, None] + np.arange(k)]
                for n in names:
                    least, f = FEATURES[n]
                    if k >= least:
                        made[n][own] = f(x)
            if "cv" in made:
                made["cv"][size == 0] = 0.0
            keep = [c for c in b.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in keep), *(pa.array(v, from_pandas=True) for v in made.values())], [*keep, *names])

    return run


def series_features(df: DataFrame, series: str, names: list[str] | None = None) -> DataFrame:
    """``df`` with the named features of an array column (all by default); columns of these names are replaced.

    Series of one length are a matrix, taken from the column's buffer, so each feature is one array operation. Null
    where a series has too few values, or one that is null or NaN; of an empty or null series ``cv`` is 0."""
    names = list(names or FEATURES)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in names)])
    return df.mapInArrow(_feature_pass(series, names), schema)
