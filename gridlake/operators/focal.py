"""Moving windows over a grid.

Sums, means, extremes and deviations are separable: one window along rows, one along columns, both in the JVM. Other
statistics run as array kernels on tiles with a halo.
Cells within half a window of the border keep 0, or null with ``border='null'``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.blocks import block_function
from gridlake.operators.edges import extend_endpoints, link
from gridlake.sources.scratch import written

SEPARABLE = ("sum", "mean", "min", "max", "percent", "std")
GATHERED = ("median", "majority", "duda", "fill-basins", "fill-peaks", "remove-min", "seg-dist")
TILED = ("edge-direction", "line-enhance", "suppression", "inhibition", "continuity", "distance", "fill", "circles")
TILE = 256


def _bounds(pixels: DataFrame) -> tuple[int, int, int, int]:
    return tuple(pixels.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first())


def _edge(bounds, half: int, border: str, value: Column) -> Column:
    i0, i1, j0, j1 = bounds
    inside = F.col("i").between(i0 + half, i1 - half) & F.col("j").between(j0 + half, j1 - half)
    return F.when(inside, value).otherwise(F.lit(0.0) if border == "zero" else F.lit(None).cast("double"))


def _separable(pixels: DataFrame, value: str, size: int, statistic: str, ignore: float | None) -> DataFrame:
    """(i, j, out): first along each row, then along each column, so 2 * size values are looked at, not size squared."""
    half = size // 2
    v = F.col(value).cast("double")
    v = v if ignore is None else F.when(v != ignore, v)
    row = Window.partitionBy("i").orderBy("j").rangeBetween(-half, half)
    col = Window.partitionBy("j").orderBy("i").rangeBetween(-half, half)
    if statistic in ("min", "max"):
        f = F.min if statistic == "min" else F.max
        return pixels.select("i", "j", f(v).over(row).alias("a")).select("i", "j", f("a").over(col).alias("out"))
    n = pixels.select("i", "j", F.sum(v).over(row).alias("s"), F.sum(v * v).over(row).alias("q"), F.count(v).over(row).cast("double").alias("n"))
    s, q, c = (F.sum(x).over(col) for x in ("s", "q", "n"))
    some = F.when(c > 0, c)
    made = {"sum": s, "mean": s / some, "percent": s / some * 100, "std": F.sqrt(F.greatest(q / some - F.pow(s / some, F.lit(2.0)), F.lit(0.0)))}[statistic]
    return n.select("i", "j", F.coalesce(made, F.lit(0.0)).alias("out"))


def gathered_kernel(name: str, a: np.ndarray, size: int, ignore: float | None = None) -> np.ndarray:
    """One statistic of the cells around each cell of an array that is NaN where there is no cell; 0 where it has none.

    ``median`` is the upper middle value; of equally frequent values ``majority`` takes the first in reading order."""
    half = size // 2
    wide = np.pad(a, half, constant_values=np.nan)
    steps = [(i, j) for i in range(size) for j in range(size)]
    at = lambda i, j: wide[half + i : half + i + a.shape[0], half + j : half + j + a.shape[1]]
    with np.errstate(invalid="ignore"):
        if name == "duda":
            out = np.zeros(a.shape)
            for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
                p, q = at(-i, -j), at(i, j)
                out = np.maximum(out, np.where((a > p) & (a > q), 2 * a - p - q, 0))
            return out
        around = np.stack([wide[i : i + a.shape[0], j : j + a.shape[1]] for i, j in steps])
        if name == "median":
            n = np.isfinite(around).sum(0)
            around.sort(0)
            out = np.take_along_axis(around, np.minimum(n // 2, len(steps) - 1)[None], 0)[0]
        elif name == "majority":
            if ignore is not None:
                around[around == ignore] = np.nan
            out, most = np.full(a.shape, np.nan), np.zeros(a.shape, int)
            for own in around:
                n = (around == own).sum(0)
                better = n > most
                out[better], most[better] = own[better], n[better]
        else:
            others = np.delete(around, half * size + half, 0)
            mean = lambda ok: np.where(ok, others, 0).sum(0) / np.where(ok.any(0), ok.sum(0), np.nan)
            if name in ("fill-basins", "fill-peaks"):
                side = others > a if name == "fill-basins" else others < a
                least = 7 if size == 3 else 2 * size + 2 * (size - 2)
                out = np.where(side.sum(0) >= least, mean(side), a)
            elif name == "remove-min":
                out = np.where(mean(others > 0) * 0.1 > a, 0.0, a)
            else:  # seg-dist
                top = np.where(np.isfinite(others), others, -np.inf).max(0)
                out = ((a == 0) | ((a < 1.4) & np.isfinite(top) & (top < 1.4))).astype(float)
    return np.nan_to_num(out, nan=0.0)


STRIP = 1 << 22  # values around cells that a kernel looks at at once


def _gathered(pixels: DataFrame, value: str, size: int, statistic: str, ignore: float | None) -> DataFrame:
    """(i, j, out) by tiles with a halo: a cell is sent to its tile and those whose halo it is in, not to each window."""
    half = size // 2

    def run(x, at):
        a = x["v"]
        step = max(1, STRIP // (a.shape[1] * size * size))
        out = np.zeros(a.shape)
        for i in range(0, a.shape[0], step):
            low = max(0, i - half)
            out[i : i + step] = gathered_kernel(statistic, a[low : i + step + half], size, ignore)[i - low : i - low + step]
        return out

    return block_function({"v": (pixels, value)}, run, ["out"], TILE, half)


# kernels on tiles: arrays in, arrays out; the halo is cut off afterwards


def _lines(size: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(angle in degrees, row steps, column steps) of lines through a window's centre, every 15 degrees."""
    half = size // 2
    out = []
    for angle in range(0, 180, 15):
        t = np.arange(-half, half + 1)
        out.append((float(angle), np.rint(-t * math.sin(math.radians(angle))).astype(int), np.rint(t * math.cos(math.radians(angle))).astype(int)))
    return out


def _shifted(a: np.ndarray, di: int, dj: int) -> np.ndarray:
    """a[i + di, j + dj], 0 outside."""
    out = np.zeros_like(a)
    h, w = a.shape
    i0, i1, j0, j1 = max(0, -di), min(h, h - di), max(0, -dj), min(w, w - dj)
    if i0 < i1 and j0 < j1:
        out[i0:i1, j0:j1] = a[i0 + di : i1 + di, j0 + dj : j1 + dj]
    return out


def _line_means(a: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.mean([_shifted(a, x, y) for x, y in zip(di, dj)], axis=0) for _, di, dj in _lines(size)])


def kernel(name: str, a: np.ndarray, size: int, **how) -> np.ndarray:
    """One statistic of a whole array; its outer half window is not meaningful."""
    half = size // 2
    disk = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1) if (i, j) != (0, 0) and i * i + j * j <= half * half + half]
    if name == "edge-direction":
        return np.array([x[0] for x in _lines(size)])[_line_means(a, size).argmax(0)]
    if name == "line-enhance":
        means = _line_means(a, size)
        rest = np.mean([_shifted(a, i, j) for i, j in disk], axis=0)
        return np.maximum(means.max(0) - rest, 0)
    if name == "suppression":
        k = _line_means(a, size).argmax(0)
        out = a.copy()
        for n, (angle, _, _) in enumerate(_lines(size)):
            across = math.radians(angle + 90)
            i, j = round(-math.sin(across)), round(math.cos(across))
            weak = (a < _shifted(a, i, j)) | (a < _shifted(a, -i, -j))
            out[(k == n) & weak] = 0
        return out
    if name == "inhibition":
        centre = np.mean([_shifted(a, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        ring = [d for d in disk if max(map(abs, d)) > 1] or disk
        return np.maximum(centre - np.mean([_shifted(a, i, j) for i, j in ring], axis=0), 0)
    if name == "continuity":
        runs = []
        for _, di, dj in _lines(size):
            best = now = np.zeros(a.shape)
            for x, y in zip(di, dj):
                now = np.where(_shifted(a, x, y) > 0, now + 1, 0)
                best = np.maximum(best, now)
            runs.append(best)
        return 1 - np.max(runs, axis=0) / size
    if name == "distance":
        near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
        return np.mean([np.abs(a - _shifted(a, i, j)) / math.hypot(i, j) for i, j in near], axis=0)
    if name == "fill":
        out = a.copy()
        n, s, w, e = (_shifted(a, i, j) > 0 for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        out[(a == 0) & ((n & s) | (w & e))] = 1
        return out
    if name == "circles":
        share = np.mean([_shifted((a > 0).astype(float), i, j) for i, j in disk if i * i + j * j > (half - 1) ** 2], axis=0)
        out = np.zeros(a.shape)
        for i, j in [*disk, (0, 0)]:
            if i * i + j * j > (half - 1) ** 2:
                out = np.maximum(out, _shifted((share >= how.get("least", 0.3)).astype(float), -i, -j))
        return out
    raise ValueError(f"unknown kernel {name!r}")


def relaxed(p: np.ndarray, compatibility: np.ndarray, size: int, iterations: int = 1) -> np.ndarray:
    """Label relaxation of class probabilities (classes, rows, columns): each cell's are multiplied by what its
    neighbours, by nearness, support; they aren't normalised again."""
    half = size // 2
    corner = math.hypot(half, half)
    steps = [(i, j, 1 - math.hypot(i, j) / corner) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    total = sum(w for *_, w in steps)
    for _ in range(iterations):
        around = np.stack([sum(w * _shifted(q, i, j) for i, j, w in steps) / total for q in p])
        p = np.einsum("ab,bij->aij", compatibility, around) * p
    return p


def relaxed_grid(pixels: DataFrame, bands: list[str], compatibility: np.ndarray, size: int = 3, iterations: int = 1, tile: int = TILE) -> DataFrame:
    """(i, j, ``bands``) of label relaxation: each round is a pass over tiles, whose halos it gets from the round before,
    so the result is that of the whole array at any ``tile``. Rounds are written tables. Cells outside count as 0."""
    one = lambda x, at: list(relaxed(np.stack([x[b] for b in bands]), np.asarray(compatibility, float), size))
    for _ in range(iterations):
        pixels = written(block_function({b: (pixels, b) for b in bands}, one, bands, tile, size // 2, 0.0))
    return pixels.select("i", "j", *bands)


def tiled(pixels: DataFrame, value: str, name: str, size: int, tile: int = TILE, **how) -> DataFrame:
    """(i, j, out) of a kernel: cells go to their tile and to those whose halo they are in; a tile is one task's array
    of its own and its halo's cells, whatever the scene. The halo is half a window, or a whole one for circles, whose ring is judged at a
    centre half a window away."""
    half = (2 if name == "circles" else 1) * (size // 2) + 1
    cuts = lambda c: F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile))
    sent = pixels.select("i", "j", F.col(value).cast("double").alias("v")).withColumn("ti", F.explode(cuts("i"))).withColumn("tj", F.explode(cuts("j")))

    def run(key, pdf):
        i0, j0 = key[0] * tile - half, key[1] * tile - half
        a = np.zeros((tile + 2 * half, tile + 2 * half))
        a[pdf.i - i0, pdf.j - j0] = pdf.v
        out = kernel(name, a, size, **how)
        own = pdf[(pdf.i // tile == key[0]) & (pdf.j // tile == key[1])]
        return pd.DataFrame({"i": own.i, "j": own.j, "out": out[own.i - i0, own.j - j0]})

    return sent.groupBy("ti", "tj").applyInPandas(run, "i bigint, j bigint, out double")


#: Weights of the eight cells around one, of sides and of corners.
SIDE, CORNER = 1.0, 0.7071


def _spectral(x: np.ndarray, index: np.ndarray, no_data: float) -> np.ndarray:
    """Of each cell: mean of its first three bands, times its index, times the weighted means over the eight cells
    around it of their distance from it in all bands and of their index's difference (where theirs is over 0)."""
    far, differ, weights = np.zeros(index.shape), np.zeros(index.shape), 0.0
    some = x != no_data
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                w = CORNER if i and j else SIDE
                d = sum(np.where(own & _shifted(own, i, j), np.nan_to_num(_shifted(a, i, j) - a) ** 2, 0) for a, own in zip(x, some))
                near = _shifted(index, i, j)
                far += w * np.sqrt(d)
                differ += w * np.where(near > 0, np.abs(index - near), 0)
                weights += w
    return x[:3].mean(0) * index * far / weights * differ / weights


def spectral_distance(pixels: DataFrame, bands: list[str], index: str, no_data: float = -9999.0, tile: int = TILE) -> DataFrame:
    """(i, j, out): how far a cell is from those around it in all bands and in a vegetation index, by its brightness and
    index. Bands that are ``no_data`` in one of two cells don't count between them. Three bands or more."""
    run = lambda x, at: _spectral(np.stack([x[f"b{k}"] for k in range(len(bands))]), x["index"], no_data)
    return block_function({f"b{k}": (pixels, b) for k, b in enumerate(bands)} | {"index": (pixels, index)}, run, ["out"], tile, 1, 0.0)


def colour_distance(pixels: DataFrame, bands: list[str], size: int = 5, tile: int = TILE) -> DataFrame:
    """(i, j, out): the sum of a cell's distances in three bands from all others of its window, by half the window
    squared less 1; null for a window of 3, where that is 0."""
    half = size // 2

    def run(x, at):
        a = np.stack(list(x.values()))
        steps = [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1) if i or j]
        total = sum(np.sqrt(sum((_shifted(b, i, j) - b) ** 2 for b in a)) for i, j in steps)
        return total / (half * half - 1) if half > 1 else np.full(total.shape, np.nan)

    return block_function({b: (pixels, b) for b in bands}, run, ["out"], tile, half, 0.0)


def moving_window(pixels: DataFrame, value: str | list[str], statistic: str, size: int = 3, ignore: float | None = None, border: str = "zero", out: str | None = None, **how) -> DataFrame:
    """(i, j, out) for every cell of a grid. ``plr`` takes class probabilities, a list of columns, and returns those;
    ``distance`` takes bands and an index last, or one column; ``rgb-distance`` takes three bands; ``link`` an edge and a gradient column, ``extend-endpoints`` edge, endpoint, gradient and direction."""
    if size % 2 == 0 or size < 3:
        raise ValueError("the window's size must be odd and 3 or more")
    if statistic == "plr":
        return relaxed_grid(pixels, value, size=size, **how)
    if statistic == "link":
        return link(pixels, *value, size=size, **how)
    if statistic == "extend-endpoints":
        return extend_endpoints(pixels, *value, size=size, **how)
    if statistic in SEPARABLE:
        made = _separable(pixels, value, size, statistic, ignore)
    elif statistic in GATHERED:
        made = _gathered(pixels, value, size, statistic, ignore)
    elif statistic == "distance" and not isinstance(value, str):
        size, made = 3, spectral_distance(pixels, value[:-1], value[-1], **({} if ignore is None else {"no_data": ignore}), **how)
    elif statistic == "rgb-distance":
        made = colour_distance(pixels, value, size, **how)
    elif statistic in TILED:
        made = tiled(pixels, value, statistic, size, **how)
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    return made.select("i", "j", _edge(_bounds(pixels), size // 2, border, F.col("out")).alias(out or "out"))


def block_statistic(pixels: DataFrame, value: str, size: int, statistic: str = "mean") -> DataFrame:
    """(i, j, out) of blocks that don't overlap, those at the edges cut."""
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}[statistic]
    return pixels.groupBy(F.floor(F.col("i") / size).alias("i"), F.floor(F.col("j") / size).alias("j")).agg(f(value).alias("out"))


def expanded(pixels: DataFrame, value: str, size: int = 3, iterations: int = 1) -> DataFrame:
    """Binary dilation by a square, cells over 0 counting as set."""
    out = pixels.select("i", "j", (F.col(value) > 0).cast("double").alias("out"))
    for _ in range(iterations):
        out = _separable(out.withColumnRenamed("out", "v"), "v", size, "max", None)
    return out


def shrunk(pixels: DataFrame, value: str, size: int = 3, iterations: int = 1) -> DataFrame:
    """Binary erosion by a square; beyond the border counts as set."""
    out = pixels.select("i", "j", (F.col(value) > 0).cast("double").alias("out"))
    for _ in range(iterations):
        out = _separable(out.withColumnRenamed("out", "v"), "v", size, "min", None)
    return out


def slope(pixels: DataFrame, elevation: str, cell: float = 1.0) -> DataFrame:
    """(i, j, slope) in degrees, from central differences, one-sided at the border."""
    across, down = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")

    def gradient(w):
        v = F.col(elevation)
        a, b = F.lag(v).over(w), F.lead(v).over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), (b - v) / cell).when(b.isNull(), (v - a) / cell).otherwise((b - a) / (2 * cell))

    g = pixels.select("i", "j", gradient(across).alias("x"), F.col(elevation))
    g = g.select("i", "j", "x", gradient(down).alias("y"))
    return g.select("i", "j", F.degrees(F.atan(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("slope"))
