"""Sampling: cells at points, points of cells, exact train and test splits, strata, weights, robust scaling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.model import Extent
from gridlake.sources.scratch import written

CROWD = 64  # targets of a cell above which cells are divided further
DEEPEST = 20  # divisions of a cell of size ``radius``, each into 16



def order(key: str, seed: int = 1) -> Column:
    """A pseudo-random order that depends on the key alone, not on partitions: 60 bits of MD5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sample_points(points: DataFrame, pixels: DataFrame, extent: Extent, bands: list[str], x: str = "x", y: str = "y", neighbours: bool = False) -> DataFrame:
    """Points with the bands of their cell (or of it and its four neighbours); points outside the extent are left out.

    Coordinates become cells, so this is an equi-join."""
    p = points.where(extent.holds(F.col(x), F.col(y))).withColumns({"i": extent.row(F.col(y)), "j": extent.column(F.col(x))})
    if neighbours:
        steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
        p = p.withColumn("s", F.explode(steps)).withColumns({"i": F.col("i") + F.col("s.di"), "j": F.col("j") + F.col("s.dj")}).drop("s")
    return p.join(pixels.select("i", "j", *bands), ["i", "j"])


def cell_points(pixels: DataFrame, extent: Extent, value: str, no_data: float = 0.0, skip: int = 0, shares: dict | None = None, seed: int = 1) -> DataFrame:
    """(x, y, value): centres of the cells that hold data; of each ``skip`` rows and columns one; of each class its share."""
    out = pixels.where(F.col(value) != no_data)
    if skip:
        out = out.where((F.col("i") % skip == 0) & (F.col("j") % skip == 0))
    if shares:
        part = F.pmod(F.xxhash64(F.lit(seed), F.col("i"), F.col("j")), F.lit(1 << 20)) / float(1 << 20)
        keep = F.lit(True)
        for c, s in shares.items():
            keep = F.when(F.col(value) == c, part < s).otherwise(keep)
        out = out.where(keep)
    return out.select(extent.x(F.col("j")).alias("x"), extent.y(F.col("i")).alias("y"), F.col(value).alias(value))


def split(df: DataFrame, key: str, label: str | None = None, share: float | None = 0.5, count: int | dict | None = None, seed: int = 1, rank: Column | None = None) -> DataFrame:
    """``df`` with ``part``: train or test. Exact numbers, of all rows or of each label: a share, rounded down, or a count.

    A count over a label's size takes the whole label for training. The order is dealt into 4096 ranges a label, whose
    sizes say how many rows come before each, so rows are only ranked within a range and no label is sorted whole.
    ``rank`` replaces the order by another, a number of 0 or more and under 2^62."""
    r = order(key, seed) if rank is None else rank
    rows = df.withColumns({"__label": F.col(label) if label else F.lit(0), "__range": F.shiftright(r, 48)})
    sizes = rows.groupBy("__label", "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__label").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("__rows").over(Window.partitionBy("__label"))
    if isinstance(count, dict):
        n = F.lit(0)
        for c, k in count.items():
            n = F.when(F.col("__label") == c, k).otherwise(n)
    else:
        n = F.lit(count) if count is not None else F.floor(size * share)
    sizes = sizes.select(F.col("__label").alias("__l"), F.col("__range").alias("__r"), (n - F.coalesce(F.sum("__rows").over(before), F.lit(0))).alias("__left"))
    place = F.row_number().over(Window.partitionBy("__label", "__range").orderBy(r, key))
    out = rows.withColumn("__rank", place).join(sizes, F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__range") == F.col("__r")))
    return out.select(*(df[c] for c in df.columns if c != "part"), F.when(F.col("__rank") <= F.col("__left"), "train").otherwise("test").alias("part"))


def strata(x: Column, y: Column, left: float, top: float, spacing: float) -> Column:
    """The square cell of a point, as row:column."""
    return F.concat_ws(":", F.floor((F.lit(top) - y) / spacing).cast("string"), F.floor((x - left) / spacing).cast("string"))


def stratified(df: DataFrame, key: str, stratum: str, count: int, seed: int = 1) -> DataFrame:
    """``count`` rows drawn in turns, one from each stratum at a time, until all strata are used up."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order(key, seed), key))
    return df.withColumn("__turn", turn).orderBy("__turn", order(key, seed), key).limit(count).drop("__turn")


def class_weights(df: DataFrame, label: str, how: str = "percent") -> DataFrame:
    """(label, n, weight): each class's share, or with ``inverse`` the share of the class as far from the other end."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    c = c.withColumn("weight", F.col("n") / total)
    if how == "percent":
        return c
    up, down = Window.orderBy("n", label), Window.orderBy(F.desc("n"), F.desc(label))
    c = c.withColumns({"__a": F.row_number().over(up), "__b": F.row_number().over(down)})
    other = c.select(F.col("__b").alias("__a"), F.col("weight").alias("inverse"))
    return c.join(other, "__a").select(label, "n", F.col("inverse").alias("weight"))


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, target key, distance) of the nearest target of each point, however far; of several the least key.

    Points and targets without coordinates are left out; without targets there are no rows. See ``_near``."""
    d = F.sqrt(F.pow(F.col("__x") - F.col("__tx"), F.lit(2.0)) + F.pow(F.col("__y") - F.col("__ty"), F.lit(2.0)))
    best = _near(points, targets, key, target_key, radius, x, y).groupBy("__k").agg(F.min(F.struct(d.alias("d"), F.col("__t").alias("t"))).alias("m"))
    return best.select(F.col("__k").alias(key), F.col("m.t").alias(target_key), F.col("m.d").alias("distance"))


def _near(points: DataFrame, targets: DataFrame, key: str, target_key: str, radius: float, x: str, y: str) -> DataFrame:
    """(__k, __x, __y, __t, __tx, __ty): each point with some targets, the nearest among them.

    Targets of equal coordinates are one, of the least key. They are hashed to square cells of size ``radius``, or of a
    quarter of it and so on until no cell holds more than ``CROWD``; those to cells four times as large, and so on up to
    one that holds all. Each point descends: of the cells below its own it keeps those whose nearest edge is no farther
    than the farthest corner of some cell, which holds a target. So it meets only targets of a few cells, however many
    there are within ``radius``, and nothing ends the search before the nearest is found."""
    p = points.select(F.col(key).alias("__k"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null")
    t = targets.select(F.col(target_key).alias("__t"), F.col(x).cast("double").alias("__tx"), F.col(y).cast("double").alias("__ty")).where("__tx is not null and __ty is not null")
    t = written(t.groupBy("__tx", "__ty").agg(F.min("__t").alias("__t")))
    edge = t.agg(F.min("__tx").alias("x"), F.min("__ty").alias("y"), F.max("__tx").alias("xx"), F.max("__ty").alias("yy")).first()
    if edge.x is None:
        return p.join(t, F.lit(False))
    for _ in range(DEEPEST):
        cell = [F.floor((F.col(c) - low) / radius) for c, low in (("__tx", edge.x), ("__ty", edge.y))]
        if t.groupBy(*cell).count().agg(F.max("count")).first()[0] <= CROWD:
            break
        radius /= 4
    t = t.withColumns({"a": F.floor((F.col("__tx") - edge.x) / radius), "b": F.floor((F.col("__ty") - edge.y) / radius)})
    last, top = max(int((edge.xx - edge.x) // radius), int((edge.yy - edge.y) // radius)), 0
    while last >> (2 * top):
        top += 1
    at = p.withColumns({"a": F.lit(0).cast("bigint"), "b": F.lit(0).cast("bigint")})
    kind = dict(p.dtypes)["__k"]
    up = lambda c, by: F.shiftright(c, 2 * by)
    for level in range(top - 1, -1, -1):
        below = t.select(up("a", level).alias("a"), up("b", level).alias("b")).distinct()
        below = below.groupBy(up("a", 1).alias("pa"), up("b", 1).alias("pb")).agg(F.collect_list(F.struct("a", "b")).alias("below"))
        below = below.select("pa", "pb", F.col("below.a").alias("na"), F.col("below.b").alias("nb"))
        if top - level <= 3:  # 256 rows or fewer, and most points of few cells, which a join by cell would lay into few tasks
            below = F.broadcast(below)
        at = at.join(below, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")))
        at = at.groupBy("__k", "__x", "__y").agg(F.flatten(F.collect_list("na")).alias("a"), F.flatten(F.collect_list("nb")).alias("b"))
        at = at.mapInArrow(_closest(edge.x, edge.y, radius * 4**level, 1e-9 * radius), f"__k {kind}, __x double, __y double, a bigint, b bigint")
    return at.join(t, ["a", "b"]).select("__k", "__x", "__y", "__t", "__tx", "__ty")


def _closest(left: float, low: float, size: float, slack: float):
    """Of each point's cells (arrays ``a`` and ``b``) those whose nearest edge is no farther than some farthest corner."""

    def run(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            n = rows.column("a").value_lengths().to_numpy()
            row = np.repeat(np.arange(rows.num_rows), n)
            near, far, cells = np.zeros(len(row)), np.zeros(len(row)), []
            for point, start, c in (("__x", left, "a"), ("__y", low, "b")):
                cells.append(rows.column(c).flatten())
                d = start + cells[-1].to_numpy() * size - rows.column(point).to_numpy()[row]
                near += np.maximum(np.maximum(d, -(d + size)), 0) ** 2
                far += np.maximum(np.abs(d), np.abs(d + size)) ** 2
            most = np.sqrt(np.minimum.reduceat(far, np.cumsum(n) - n))
            kept = np.flatnonzero(~(np.sqrt(near) > (most * (1 + 1e-9) + slack)[row]))  # NaN stays
            points = rows.select(["__k", "__x", "__y"]).take(pa.array(row[kept]))
            yield pa.RecordBatch.from_arrays([*points.columns, *(c.take(pa.array(kept)) for c in cells)], ["__k", "__x", "__y", "a", "b"])

    return run


def distance_weights(near: DataFrame) -> DataFrame:
    """Weights of 1 less the distance's share of the largest distance."""
    most = near.agg(F.max("distance")).first()[0] or 0.0
    return near.withColumn("weight", 1 - F.col("distance") / most if most > 0 else F.lit(1.0))


def robust_scaled(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns less their median, by the range between two quantiles; unchanged in scale where that is 0."""
    got = df.agg(*(F.percentile(c, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias(c) for c in columns)).first()
    made = {}
    for c in columns:
        a, m, b = got[c] or (0.0, 0.0, 0.0)
        made[c] = (F.col(c) - m) / ((b - a) or 1.0)
    return df.withColumns(made)


def chi_square(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, score): of each feature, moved to be 0 or more, the sums by label against those expected by label sizes."""
    low = df.agg(*(F.least(F.min(f), F.lit(0.0)).alias(f) for f in features)).first()
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") - low[f]).alias("v")) for f in features))).alias("x")).select(label, "x.*")
    obs = long.groupBy("feature", label).agg(F.sum("v").alias("o"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature")
    e = F.sum("o").over(w) * F.col("n") / F.sum("n").over(w)
    return obs.withColumn("e", e).groupBy("feature").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.when(F.col("e") > 0, F.col("e")))).alias("score"))
