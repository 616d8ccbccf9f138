"""Distance of every cell to the nearest target cell: an exact Euclidean transform, along columns and then along rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 16  # rows of cells that a group holds


def lower_envelope(g: np.ndarray) -> np.ndarray:
    """min over k of (j - k)^2 + g[r, k] for each row r and column j, inf where a row is all inf.

    A parabola over each column; those that are lowest somewhere are kept on a stack, for all rows at once."""
    rows, width = g.shape
    of, at, top = np.zeros((rows, width), np.int64), np.full((rows, width + 1), np.inf), np.full(rows, -1)
    every = np.arange(rows)
    for q in range(width):
        todo = every[np.isfinite(g[:, q])]
        own, start = todo, np.full(rows, -np.inf)
        while len(todo):
            todo = todo[top[todo] >= 0]
            k = of[todo, top[todo]]
            s = ((g[todo, q] + q * q) - (g[todo, k] + k * k)) / (2.0 * (q - k))
            under = s <= at[todo, top[todo]]
            start[todo] = np.where(under, -np.inf, s)
            todo = todo[under]
            top[todo] -= 1
        top[own] += 1
        of[own, top[own]], at[own, top[own]] = q, start[own]
    out, k = np.full(g.shape, np.inf), np.zeros(rows, np.int64)
    some = every[top >= 0]
    for q in range(width):
        more = some
        while len(more):
            more = more[(k[more] < top[more])]
            more = more[at[more, k[more] + 1] < q]
            k[more] += 1
        v = of[some, k[some]]
        out[some, q] = (q - v) ** 2 + g[some, v]
    return out


def distance_to(pixels: DataFrame, target: Column, most: float | None = None) -> DataFrame:
    """(i, j, distance) of each cell: to the nearest cell, itself included, where ``target`` is true, in cells.

    Null where there is none, or none within ``most``. First windows carry the last target along each column, down and
    up; then each row takes the lower envelope of its columns' parabolas, some rows to a group. Both passes look at
    each cell a fixed number of times whatever the distances. The grid is taken as the rectangle of its cells; cells
    that have no row are no targets, and get no row."""
    cells = pixels.groupBy("i", "j").agg(F.max(F.coalesce(target, F.lit(False))).alias("hit")).where("i is not null and j is not null")
    edge = cells.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    if edge[0] is None:
        return cells.select("i", "j", F.lit(None).cast("double").alias("distance"))
    i0, i1, j0, j1 = edge
    width = j1 - j0 + 1
    full = pixels.sparkSession.range((i1 - i0 + 1) * width).select((F.floor(F.col("id") / width) + i0).alias("i"), (F.col("id") % width + j0).alias("j"))
    full = full.join(cells, ["i", "j"], "left")
    at = F.when(F.col("hit"), F.col("i"))
    down, up = Window.partitionBy("j").orderBy("i"), Window.partitionBy("j").orderBy(F.desc("i"))
    near = full.select("i", "j", F.col("hit").isNotNull().alias("there"), (F.col("i") - F.max(at).over(down)).alias("above"), (F.min(at).over(up) - F.col("i")).alias("below"))
    near = near.select("i", "j", "there", F.least("above", "below").cast("double").alias("d"))

    def run(key, pdf):
        first = int(key[0]) * ROWS
        g = np.full((ROWS, width), np.inf)
        g[pdf.i - first, pdf.j - j0] = np.square(pdf.d.fillna(np.inf))
        d = np.sqrt(lower_envelope(g))
        own = pdf[pdf.there]
        return pd.DataFrame({"i": own.i, "j": own.j, "distance": d[own.i - first, own.j - j0]})

    out = near.groupBy(F.floor(F.col("i") / ROWS).alias("g")).applyInPandas(run, "i bigint, j bigint, distance double")
    inside = F.col("distance") < float("inf") if most is None else F.col("distance") <= most
    return out.select("i", "j", F.when(inside, F.col("distance")).alias("distance"))
