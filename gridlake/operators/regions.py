"""Regions of a class map and their outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators import graph

TILE = 256
ROW = 1 << 30  # columns that a cell number leaves room for


def cell_number(i, j):
    return i * ROW + j


def _labels(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The least flat index of each cell's region of equal values in a tile, by edges hooked to the lesser root."""
    at = np.arange(a.size).reshape(a.shape)
    across, down = there[:, 1:] & there[:, :-1] & (a[:, 1:] == a[:, :-1]), there[1:] & there[:-1] & (a[1:] == a[:-1])
    x, y = np.r_[at[:, :-1][across], at[:-1][down]], np.r_[at[:, 1:][across], at[1:][down]]
    root = at.ravel().copy()
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root.reshape(a.shape)


def regions(pixels: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    """(i, j, value, region): cells of equal values that touch by their sides are one region, named by the cell number
    (``cell_number``) of its first cell in reading order.

    Each tile is labelled on its own; labels that meet at a seam are edges, and the components of those name the
    regions that several tiles share, so a region may be of any size and shape. The result doesn't depend on ``tile``.
    Cells without value belong to no region and are left out; of several rows of a cell one counts."""
    src = pixels.where(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("v"))

    def run(key, pdf):
        pdf = pdf.drop_duplicates(["i", "j"])
        i, j = pdf.i - int(key[0]) * tile, pdf.j - int(key[1]) * tile
        a, there = np.zeros((tile, tile)), np.zeros((tile, tile), bool)
        a[i, j], there[i, j] = pdf.v, True
        first = _labels(a, there)[i, j]
        return pd.DataFrame({"i": pdf.i, "j": pdf.j, "v": pdf.v, "label": cell_number(int(key[0]) * tile + first // tile, int(key[1]) * tile + first % tile)})

    local = src.groupBy(F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj")).applyInPandas(run, "i bigint, j bigint, v double, label bigint")
    local = graph.written(local)
    seams = None
    for c, di, dj in (("i", 1, 0), ("j", 0, 1)):
        before = local.where(F.pmod(F.col(c), F.lit(tile)) == tile - 1).select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), "v", F.col("label").alias("a"))
        met = before.join(local.where(F.pmod(F.col(c), F.lit(tile)) == 0), ["i", "j", "v"]).select("a", F.col("label").alias("b")).distinct()
        seams = met if seams is None else seams.unionByName(met)
    root = graph.components(seams)
    out = local.join(root, local["label"] == root["node"], "left")
    return out.select("i", "j", F.col("v").alias(value), F.coalesce("root", "label").alias("region"))


#: Sides of a cell as edges with the cell on their right: (row, column) of the first corner, direction, the neighbour
#: across; then the cells that decide how an outline goes on at the last corner, and the side it takes in each case.
_SIDES = (
    ((0, 0), (0, 1), (-1, 0), (0, 1), (-1, 1)),
    ((0, 1), (1, 0), (0, 1), (1, 0), (1, 1)),
    ((1, 1), (0, -1), (1, 0), (0, -1), (1, -1)),
    ((1, 0), (-1, 0), (0, -1), (-1, 0), (-1, -1)),
)


def _chains(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place) of each node: the node that its chain begins with, and how many come before it.

    ``after`` is the node that follows, the node itself where none does. A closed chain begins with its least node."""
    at = np.arange(len(after))
    least, far = at, after
    for _ in range(max(len(after) - 1, 1).bit_length()):
        least, far = np.minimum(least, least[far]), far[far]
    after = np.where((after[far] != far) & (after == least[after]), at, after)
    far, ahead = after, (after != at).astype(np.int64)
    while (far[far] != far).any():
        ahead, far = ahead + ahead[far], far[far]
    begins = np.ones(len(after), bool)
    begins[after[after != at]] = False
    first = np.zeros(len(after), np.int64)
    first[far[begins]] = at[begins]
    return first[far], ahead[first[far]] - ahead


def outlines(labelled: DataFrame, region: str = "region", tile: int = TILE) -> DataFrame:
    """(region, ring, position, row, column): the corners of each region's rings, in order and clockwise in map view for
    outer rings, the other way for holes, one for each cell side.

    Every side between a region and what isn't of it is an edge. Which edge follows is known from the cells around its
    end: an outline keeps to its cell, else goes on to the next, so where two cells of a region touch by a corner only,
    rings touch but don't cross. Each tile follows its edges to where they leave it: rings within a tile are done there,
    of the others only whole arcs, one for each passage of a seam, become components whose positions come by doubling,
    so that no ring is gathered in one place. ``ring`` is its least edge number, at which positions begin."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    sent = labelled.select("i", "j", F.col(region).alias("r")).withColumn("ti", near("i")).withColumn("tj", near("j"))

    def run(key, pdf):
        i0, j0 = int(key[0]) * tile - 1, int(key[1]) * tile - 1
        a = np.full((tile + 2, tile + 2), -1, np.int64)
        a[pdf.i - i0, pdf.j - j0] = pdf.r
        own = pdf[(pdf.i // tile == key[0]) & (pdf.j // tile == key[1])]
        i, j, r = own.i.to_numpy() - i0, own.j.to_numpy() - j0, own.r.to_numpy()
        parts = []
        for side, ((ci, cj), _, (ni, nj), (si, sj), (oi, oj)) in enumerate(_SIDES):
            e = a[i + ni, j + nj] != r
            x, y, of = i[e], j[e], r[e]
            straight = a[x + si, y + sj] == of
            left = straight & (a[x + oi, y + oj] == of)
            ti, tj = np.where(left, oi, np.where(straight, si, 0)), np.where(left, oj, np.where(straight, sj, 0))
            turn = np.where(left, (side + 3) % 4, np.where(straight, side, (side + 1) % 4))
            inside = (x + ti >= 1) & (x + ti <= tile) & (y + tj >= 1) & (y + tj <= tile)
            parts.append(pd.DataFrame({"region": of, "id": cell_number(x + i0, y + j0) * 4 + side, "after": cell_number(x + ti + i0, y + tj + j0) * 4 + turn, "inside": inside, "row": x + i0 + ci, "column": y + j0 + cj}))
        e = pd.concat(parts).sort_values("id")
        number, after, inside = e.id.to_numpy(), e.after.to_numpy(), e.inside.to_numpy()
        first, place = _chains(np.where(inside, np.searchsorted(number, after), np.arange(len(e))) if len(e) else np.zeros(0, np.int64))
        out = pd.DataFrame({"region": e.region, "row": e.row, "column": e.column, "arc": number[first], "place": place, "open": False, "after": 0, "size": 0, "least": 0, "turn": 0})
        ends, size = np.flatnonzero(~inside), np.bincount(first, minlength=len(e))
        least = np.full(len(e), len(e))
        np.minimum.at(least, first, np.arange(len(e)))
        head = first[ends]
        leaves = np.zeros(len(e), bool)
        leaves[head] = True
        out["open"] = leaves[first]
        for c, v in (("after", after[ends]), ("size", size[head]), ("least", number[least[head]]), ("turn", place[least[head]])):
            x = np.zeros(len(e), np.int64)
            x[head] = v
            out[c] = x
        return out

    made = graph.written(sent.groupBy("ti", "tj").applyInPandas(run, "region bigint, row bigint, column bigint, arc bigint, place bigint, open boolean, after bigint, size bigint, least bigint, turn bigint"))
    arcs = made.where("size > 0").select("arc", "after", "size", "least", "turn")
    loop = graph.components(arcs, "arc", "after")
    arcs = graph.written(arcs.join(loop, arcs["arc"] == loop["node"]).drop("node"))
    start = graph.positions(arcs, "arc", "after", "root", "size")
    arcs = graph.written(arcs.join(start, arcs["arc"] == start["node"]).select("arc", "root", "size", "position", F.struct("least", (F.col("position") + F.col("turn")).alias("turn")).alias("first")))
    whole = arcs.groupBy("root").agg(F.min("first").alias("begin"), F.sum("size").alias("corners"))
    arcs = arcs.join(whole, "root").select("arc", F.col("begin.least").alias("ring"), (F.col("position") - F.col("begin.turn")).alias("start"), "corners")
    within = made.where("not open").select("region", F.col("arc").alias("ring"), F.col("place").alias("position"), "row", "column")
    return within.unionByName(made.where("open").join(arcs, "arc").select("region", "ring", F.pmod(F.col("start") + F.col("place"), F.col("corners")).alias("position"), "row", "column"))


RUN = 4096  # corners of a ring that a window takes at once


def ring_areas(rings: DataFrame) -> DataFrame:
    """(region, ring, area, corners) of outlines: cells inside, below 0 for holes; sums over corners, in no order.

    The area is the integral of columns over rows along the ring, whose steps go from each corner to the next: within
    runs of ``RUN`` corners first, then from each run's last to the next one's first."""
    step = F.lead("row").over(Window.partitionBy("ring", "run").orderBy("position")) - F.col("row")
    runs = rings.withColumn("run", F.floor(F.col("position") / RUN)).withColumn("step", step).groupBy("region", "ring", "run").agg(
        F.sum(F.col("column") * F.col("step")).alias("area"),
        F.count(F.lit(1)).alias("corners"),
        F.min_by("row", "position").alias("first"),
        F.max_by("row", "position").alias("row"),
        F.max_by("column", "position").alias("column"),
    )
    w = Window.partitionBy("ring").orderBy("run")
    on: Column = F.coalesce(F.lead("first").over(w), F.first("first").over(w)) - F.col("row")
    return runs.withColumn("step", on).groupBy("region", "ring").agg(F.sum(F.coalesce("area", F.lit(0)) + F.col("column") * F.col("step")).alias("area"), F.sum("corners").alias("corners"))
