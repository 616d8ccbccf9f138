"""Scans and map algebra: windows, overlays, mosaics, pyramids, calculators, masks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.expressions import expressions
from gridlake.model import Extent


def window(pixels: DataFrame, i: int, j: int, rows: int, columns: int, bands: list[str] | None = None) -> DataFrame:
    """The cells of a window; a range predicate that reaches the scan, and only the bands asked for."""
    out = pixels.where(F.col("i").between(i, i + rows - 1) & F.col("j").between(j, j + columns - 1))
    return out.select("i", "j", *bands) if bands else out


def samples(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Bands as one array column, band 1 first."""
    return pixels.select("i", "j", F.array(*(F.col(b).cast("double") for b in bands)).alias("bands"))


def spread(sampled: DataFrame, names: list[str]) -> DataFrame:
    """The array column as one column for each name."""
    return sampled.select("i", "j", *(F.element_at("bands", k).alias(n) for k, n in enumerate(names, 1)))


def long_form(sampled: DataFrame) -> DataFrame:
    """(i, j, band, value), bands from 1."""
    return sampled.select("i", "j", F.posexplode("bands").alias("p", "value")).select("i", "j", (F.col("p") + 1).alias("band"), "value")


def aligned(pixels: DataFrame, own: Extent, common: Extent) -> DataFrame:
    """Cells inside ``common``, numbered from its upper left corner."""
    di, dj = own.offsets(common.left + common.width / 2, common.top - common.height / 2)
    rows, columns = common.shape
    cut = pixels.where(F.col("i").between(di, di + rows - 1) & F.col("j").between(dj, dj + columns - 1))
    return cut.withColumns({"i": F.col("i") - di, "j": F.col("j") - dj})


def overlay(layers: dict[str, tuple[DataFrame, Extent, str]]) -> DataFrame:
    """(i, j, one column for each layer) on the layers' common extent: an equi-join on cells after each is cut to it."""
    common = reduce(lambda a, b: a.intersection(b), (e for _, e, _ in layers.values()))
    parts = [aligned(df.select("i", "j", F.col(band).alias(name)), e, common) for name, (df, e, band) in layers.items()]
    return reduce(lambda a, b: a.join(b, ["i", "j"]), parts)


def calculate(layers: dict[str, tuple[DataFrame, Extent, str]], equation: str, no_data: float = 0.0) -> DataFrame:
    """An equation over layers on their common extent; parts between ``&&`` become bands b1, b2 and so on."""
    grid = overlay(layers) if len(layers) > 1 else reduce(lambda a, b: a, ((df.select("i", "j", F.col(band).alias(n))) for n, (df, _, band) in layers.items()))
    made = expressions(equation, {n: F.col(n) for n in layers}, no_data)
    return grid.select("i", "j", *(c.alias(f"b{k}") for k, c in enumerate(made, 1)))


def mosaic(layers: list[DataFrame], value: str, no_data: float | None = 0.0) -> DataFrame:
    """One value for each cell of any layer; where several have one, the last layer's that isn't no data."""
    each = [df.select("i", "j", F.col(value).alias("v"), F.lit(k).alias("k")) for k, df in enumerate(layers)]
    every = reduce(DataFrame.unionByName, each)
    good = F.when(F.lit(True) if no_data is None else F.col("v") != no_data, F.col("v"))
    best = F.max_by(F.col("v"), F.when(good.isNotNull(), F.col("k")))
    return every.groupBy("i", "j").agg(F.coalesce(best, F.lit(no_data)).alias(value))


def stack(layers: dict[str, DataFrame], value: str, full: bool = False) -> DataFrame:
    """One column for each layer; cells of all layers, or with ``full`` of any."""
    parts = [df.select("i", "j", F.col(value).alias(n)) for n, df in layers.items()]
    return reduce(lambda a, b: a.join(b, ["i", "j"], "full" if full else "inner"), parts)


def pyramid(pixels: DataFrame, value: str, level: int, how: str = "nearest") -> DataFrame:
    """The overview of cells ``level`` times as large: their upper left cell's value, or their mean."""
    i, j = F.floor(F.col("i") / level).alias("i"), F.floor(F.col("j") / level).alias("j")
    if how == "mean":
        return pixels.groupBy(i, j).agg(F.avg(value).alias(value))
    return pixels.where((F.col("i") % level == 0) & (F.col("j") % level == 0)).select(i, j, value)


def resample(pixels: DataFrame, source: Extent, target: Extent, value: str, how: str = "nearest") -> DataFrame:
    """Values on another grid of the same reference system: of the cell under each centre, or the mean of centres inside."""
    if how == "mean":
        x, y = source.x(F.col("j")), source.y(F.col("i"))
        return pixels.where(target.holds(x, y)).groupBy(target.row(y).alias("i"), target.column(x).alias("j")).agg(F.avg(value).alias(value))
    rows, columns = target.shape
    spark = pixels.sparkSession
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("ti"), (F.col("id") % columns).alias("tj"))
    cells = cells.select("ti", "tj", source.row(target.y(F.col("ti"))).alias("i"), source.column(target.x(F.col("tj"))).alias("j"))
    return cells.join(pixels.select("i", "j", value), ["i", "j"]).select(F.col("ti").alias("i"), F.col("tj").alias("j"), value)


TILE = 256  # target cells of a tile, or the source cells under it, on each side


def _taps(f, how: str) -> list:
    """(step, weight) of the cells that an inner position takes part of, ``f`` past the first one's centre."""
    if how == "bilinear":
        return [(0, 1 - f), (1, f)]
    near = lambda d: (1.5 * d - 2.5) * d * d + 1  # noqa: E731  cubic convolution with a = -0.5
    far = lambda d: ((-0.5 * d + 2.5) * d - 4) * d + 2
    return [(-1, far(f + 1)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f))]


def warp(pixels: DataFrame, source: Extent, target: Extent, value: str, how: str = "bilinear", no_data: float | None = None) -> DataFrame:
    """(i, j, value) on another grid of the same reference system, weighted over the 4 (``bilinear``) or 16 (``cubic``)
    source cells around each target cell's centre.

    Cells that are missing, null or ``no_data`` take no part and the other weights are scaled to add up to 1; a target
    cell is left out where its centre is outside the source, or what is left weighs nothing or less. Source cells are
    sent once to each tile of target cells that they take part in, with those around it, and weighted there."""
    if how not in ("bilinear", "cubic"):
        raise ValueError(f"no kernel {how!r}")
    rows, columns = target.shape
    reach = 1 if how == "bilinear" else 2
    tile = {"i": max(1, min(TILE, int(TILE * source.height / target.height))), "j": max(1, min(TILE, int(TILE * source.width / target.width)))}
    v0, dv = (source.top - target.top) / source.height - 0.5, target.height / source.height
    u0, du = (target.left - source.left) / source.width - 0.5, target.width / source.width

    def tiles(c, start, step, size, cells):
        first, last = F.ceil((F.col(c) - reach - start) / step - 0.5 - 1e-6), F.floor((F.col(c) + reach - start) / step - 0.5 + 1e-6)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(cells - 1))
        return F.explode(F.when(first <= last, F.sequence(F.floor(first / size), F.floor(last / size))).otherwise(F.array().cast("array<bigint>")))

    good = F.col(value).isNotNull() if no_data is None else F.col(value) != no_data
    sent = pixels.where(good).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col(value).cast("double").alias("v"))
    sent = sent.withColumn("ti", tiles("i", v0, dv, tile["i"], rows)).withColumn("tj", tiles("j", u0, du, tile["j"], columns))

    def axis(first, size, cells, low, step, start, width, sign, edges):
        """The target cells of a tile whose centres are inside, their first source cells and the weights of the taps."""
        t = np.arange(first, min(first + size, cells))
        at = low + sign * (t + 0.5) * step
        t, at = t[(at > edges[0]) & (at < edges[1])], at[(at > edges[0]) & (at < edges[1])]
        p = sign * (at - start) / width - 0.5
        base = np.floor(p)
        return t, base.astype(np.int64), _taps(p - base, how)

    def run(key, pdf):
        ti, vi, wi = axis(int(key[0]) * tile["i"], tile["i"], rows, target.top, target.height, source.top, source.height, -1, (source.bottom, source.top))
        tj, vj, wj = axis(int(key[1]) * tile["j"], tile["j"], columns, target.left, target.width, source.left, source.width, 1, (source.left, source.right))
        if not len(ti) or not len(tj):
            return pd.DataFrame({"i": [], "j": [], value: []})
        i0, j0 = vi[0] - 1, vj[0] - 1
        total, count = (np.zeros((vi[-1] - i0 + 3, vj[-1] - j0 + 3)) for _ in range(2))
        i, j = pdf.i.to_numpy() - i0, pdf.j.to_numpy() - j0
        held = (i >= 0) & (j >= 0) & (i < total.shape[0]) & (j < total.shape[1])
        np.add.at(total, (i[held], j[held]), pdf.v.to_numpy()[held])
        np.add.at(count, (i[held], j[held]), 1)
        s, w = np.zeros((len(ti), len(tj))), np.zeros((len(ti), len(tj)))
        for a, wa in wi:
            for b, wb in wj:
                at, weight = np.ix_(vi + a - i0, vj + b - j0), wa[:, None] * wb
                s += np.where(weight != 0, weight * total[at], 0)
                w += weight * count[at]
        x, y = np.nonzero(w > 1e-9)
        return pd.DataFrame({"i": ti[x], "j": tj[y], value: s[x, y] / w[x, y]})

    return sent.groupBy("ti", "tj").applyInPandas(run, f"i bigint, j bigint, `{value}` double")


def translate(pixels: DataFrame, value: str, i: int, j: int, rows: int, columns: int, scale: tuple[float, float, float, float] | None = None, kind: str = "double") -> DataFrame:
    """A window, numbered from 0, with values mapped from one range to another and cast."""
    v = F.col(value).cast("double")
    if scale:
        a, b, c, d = scale
        v = (v - a) * ((d - c) / (b - a)) + c
    return window(pixels, i, j, rows, columns).select((F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), v.cast(kind).alias(value))


def statistics(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(band, min, max, mean, std) over all cells; population deviation."""
    long = pixels.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))).alias("x")).select("x.*")
    return long.groupBy("band").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def contains_value(pixels: DataFrame, bands: list[str], value: float) -> DataFrame:
    """(band, found, cells): whether each band holds a value, and in how many cells; NaN is found as NaN."""
    long = pixels.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))).alias("x")).select("x.*")
    return long.groupBy("band").agg(F.count_if(F.col("v") == value).alias("cells")).select("band", (F.col("cells") > 0).alias("found"), "cells")


def clear_share(pixels: DataFrame, value: str, clear: float, background: float) -> DataFrame:
    """Percent of cells other than background that are clear."""
    n = F.count_if(F.col(value) != background)
    return pixels.agg(F.when(n > 0, F.count_if(F.col(value) == clear) * 100.0 / F.when(n > 0, n)).alias("clear_percent"))


def masked(pixels: DataFrame, mask: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Values where ``mask`` has the cell, ``fill`` elsewhere."""
    m = mask.select("i", "j").distinct().withColumn("__in", F.lit(True))
    return pixels.join(m, ["i", "j"], "left").withColumn(value, F.when(F.col("__in"), F.col(value)).otherwise(F.lit(fill))).drop("__in")


def filled_where_empty(existing: DataFrame, new: DataFrame, value: str, empty: float = 0.0) -> DataFrame:
    """New values only where the existing one is empty or absent; no row of either is lost."""
    a = existing.select("i", "j", F.col(value).alias("__old"))
    b = new.select("i", "j", F.col(value).alias("__new"))
    keep = F.when(F.col("__old").isNull() | ((F.col("__old") == empty) & F.col("__new").isNotNull()), F.col("__new")).otherwise(F.col("__old"))
    return a.join(b, ["i", "j"], "full").select("i", "j", keep.alias(value))


def pan_sharpen(grid: DataFrame, bands: list[str], pan: str, weights: list[float] | None = None, how: str = "brovey") -> DataFrame:
    """Bands sharpened by a panchromatic band on the same grid: scaled by its share of the bands' weighted sum
    (``brovey``), or shifted by its difference from their weighted mean (``esri``)."""
    w = weights or [1.0 / len(bands)] * len(bands)
    low: Column = reduce(lambda a, b: a + b, (F.col(b) * x for b, x in zip(bands, w)))
    new = {b: F.when(low != 0, F.col(b) * F.col(pan) / F.when(low != 0, low)) if how == "brovey" else F.col(b) + (F.col(pan) - low) for b in bands}
    return grid.withColumns(new)
