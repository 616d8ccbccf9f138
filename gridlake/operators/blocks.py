"""User functions over blocks of several layers: co-grouped tiles with a halo, their cells and their partial totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
Layers = dict[str, tuple[DataFrame, str]]


def _tiles(layers: Layers, tile: int, halo: int) -> DataFrame:
    """Every layer's cells, sent to their tile and to those in whose halo they are: one shuffle for all layers."""
    cells = [df.select("i", "j", F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, (df, c) in enumerate(layers.values())]
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    return reduce(DataFrame.unionByName, cells).where("i is not null and j is not null").withColumn("ti", near("i")).withColumn("tj", near("j"))


def _arrays(key: tuple, pdf: pd.DataFrame, names: list[str], tile: int, halo: int, fill: float) -> tuple[dict[str, np.ndarray], tuple[int, int]]:
    """({layer: array with its halo}, (row, column) of the arrays' upper left cell)."""
    i0, j0 = int(key[0]) * tile - halo, int(key[1]) * tile - halo
    out = np.full((len(names), tile + 2 * halo, tile + 2 * halo), fill)
    out[pdf.k, pdf.i - i0, pdf.j - j0] = pdf.v.to_numpy(float, na_value=fill)
    return dict(zip(names, out)), (i0, j0)


def block_function(layers: Layers, function: Callable, out: list[str], tile: int = TILE, halo: int = 0, fill: float = np.nan) -> DataFrame:
    """(i, j, the columns of ``out``): a function of blocks, for each cell that any layer has.

    ``layers`` maps names to (pixels, column). ``function({name: array}, (i, j))`` gets each layer's square array, wider
    by ``halo`` on all sides, with ``fill`` where the layer has no cell or a null, and the row and column of the arrays'
    first cell. It returns an array of the same shape, or one for each name of ``out``; the halo of it is cut off. If
    the function of a cell depends on cells within the halo only, the result doesn't depend on ``tile``. A task holds
    one block of all layers at a time. No cells, no rows; of several rows of a cell one counts."""
    names = list(layers)

    def run(key, pdf):
        arrays, (i0, j0) = _arrays(key, pdf, names, tile, halo, fill)
        made = function(arrays, (i0, j0))
        made = [made] if isinstance(made, np.ndarray) else list(made)
        own = pdf.loc[(pdf.i // tile == key[0]) & (pdf.j // tile == key[1]), ["i", "j"]].drop_duplicates()
        return pd.DataFrame({"i": own.i, "j": own.j, **{n: a[own.i - i0, own.j - j0].astype(float) for n, a in zip(out, made, strict=True)}})

    return _tiles(layers, tile, halo).groupBy("ti", "tj").applyInPandas(run, ", ".join(["i bigint, j bigint", *(f"{n} double" for n in out)]))


def block_totals(layers: Layers, function: Callable, how: dict[str, str], tile: int = TILE, halo: int = 0, fill: float = np.nan) -> DataFrame:
    """(name, value) of what a function gathers from blocks, merged over all blocks.

    ``function({name: array}, (i, j), own)`` returns a dict of numbers, of its own cells, which the boolean array
    ``own`` marks; ``how`` says for each name whether they are merged by sum, min or max. A name that no block has, and
    NaN, is left out. Totals merge within tasks before they are sent."""
    names = list(layers)

    def run(key, pdf):
        arrays, (i0, j0) = _arrays(key, pdf, names, tile, halo, fill)
        own = np.zeros((tile + 2 * halo,) * 2, bool)
        mine = pdf[(pdf.i // tile == key[0]) & (pdf.j // tile == key[1])]
        own[mine.i - i0, mine.j - j0] = True
        got = {k: float(v) for k, v in function(arrays, (i0, j0), own).items()} if own.any() else {}
        return pd.DataFrame({"name": list(got), "value": list(got.values())}, columns=["name", "value"]).astype({"name": object, "value": float})

    each = _tiles(layers, tile, halo).groupBy("ti", "tj").applyInPandas(run, "name string, value double").where("value is not null and not isnan(value)")
    chosen = [F.when(F.col("name").isin([n for n, h in how.items() if h == kind] or [""]), f("value")) for kind, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    return each.where(F.col("name").isin(list(how))).groupBy("name").agg(F.coalesce(*chosen).alias("value"))
