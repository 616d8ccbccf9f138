"""Closing gaps in edge maps. Rules look at all cells at once, in no order, so results don't depend on how a grid is cut."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from gridlake.operators.blocks import TILE, block_function

_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
SLACK = 2  # cells by which a path may leave the box of its ends


def _moved(a: np.ndarray, i: int, j: int, fill=0) -> np.ndarray:
    """a[x + i, y + j], ``fill`` outside."""
    wide = np.pad(a, ((max(0, -i), max(0, i)), (max(0, -j), max(0, j))), constant_values=fill)
    return wide[max(0, i) : max(0, i) + a.shape[0], max(0, j) : max(0, j) + a.shape[1]]


def endpoints_of(edge: np.ndarray) -> np.ndarray:
    """Edge cells with exactly one edge cell among the eight around them."""
    return edge & (sum(_moved(edge.astype(int), i, j) for i, j in _AROUND) == 1)


def least_path(gradient: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    """(cost, cells from start to end) of the cheapest way within the ends' box and ``SLACK`` cells around it.

    A step costs its length over 1 and the gradient of the cell that it enters; cells without gradient can't be entered."""
    low = [min(a, b) - SLACK for a, b in zip(start, end)]
    high = [max(a, b) + SLACK for a, b in zip(start, end)]
    best, before, todo = {start: 0.0}, {}, [(0.0, start)]
    while todo:
        cost, at = heapq.heappop(todo)
        if at == end:
            way = [at]
            while way[-1] != start:
                way.append(before[way[-1]])
            return cost, way[::-1]
        if cost > best[at]:
            continue
        for i, j in _AROUND:
            to = at[0] + i, at[1] + j
            if low[0] <= to[0] <= high[0] and low[1] <= to[1] <= high[1] and 0 <= to[0] < gradient.shape[0] and 0 <= to[1] < gradient.shape[1] and not np.isnan(gradient[to]):
                further = cost + float(np.hypot(i, j)) / (1 + max(float(gradient[to]), 0.0))
                if further < best.get(to, np.inf) or (further == best.get(to) and at < before[to]):
                    best[to], before[to] = further, at
                    heapq.heappush(todo, (further, to))
    return np.inf, []


def linked_array(edge: np.ndarray, gradient: np.ndarray, size: int, least: float) -> np.ndarray:
    """``edge`` with the paths between endpoints that choose each other; see ``link``."""
    half = size // 2
    ends = [tuple(x) for x in np.argwhere(endpoints_of(edge)).tolist()]
    known = set(ends)
    away = {}
    for i, j in ends:
        a, b = next((a, b) for a, b in _AROUND if 0 <= i + a < edge.shape[0] and 0 <= j + b < edge.shape[1] and edge[i + a, j + b])
        away[i, j] = (-a, -b)
    best = {}
    for i, j in ends:
        seen = []
        for a in range(-half, half + 1):
            for b in range(-half, half + 1):
                to = (i + a, j + b)
                if max(abs(a), abs(b)) > 1 and to in known and away[i, j][0] * a + away[i, j][1] * b > 0 and away[to][0] * a + away[to][1] * b < 0:
                    seen.append((a * a + b * b, to))
        if seen:
            best[i, j] = min(seen)[1]
    out = edge.copy()
    for start, end in best.items():
        if start < end and best.get(end) == start:
            _, way = least_path(gradient, start, end)
            if len(way) > 2 and np.mean([gradient[c] for c in way[1:-1]]) >= least:
                for c in way[1:-1]:
                    out[c] = True
    return out


def link(pixels: DataFrame, edge: str, gradient: str, size: int = 15, least: float = 25.0, tile: int = TILE) -> DataFrame:
    """(i, j, out): 1 for edge cells and for those that close gaps between them, else 0.

    An endpoint has one edge neighbour. It chooses the nearest endpoint within half of ``size`` that lies ahead of it
    and that it lies ahead of, of several the first in reading order. Two that choose each other are joined by the path
    of least cost over the gradient, if the mean gradient between them is ``least`` or more. Cells without gradient
    aren't crossed. No choice waits for another, so a block with a halo of all that a path can depend on gives what the
    whole grid gives."""

    def run(x, at):
        return linked_array(x["edge"] > 0, x["gradient"], size, least).astype(float)

    return block_function({"edge": (pixels, edge), "gradient": (pixels, gradient)}, run, ["out"], tile, 3 * (size // 2) + SLACK + 2)


def extended_array(edge: np.ndarray, ends: np.ndarray, gradient: np.ndarray, direction: np.ndarray, size: int, near: float, least: float) -> np.ndarray:
    """``edge`` with the cell that each endpoint takes; see ``extend_endpoints``."""
    half, far = size // 2, np.inf
    steps = sorted(((a * a + b * b, a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if (a, b) != (0, 0)))
    free, strong = ~edge & (gradient >= least), ends & (gradient >= least)

    def fits(a, b):
        """Difference of gradient between cells and the endpoint at an offset from them, inf where they don't fit."""
        with np.errstate(invalid="ignore"):
            d = np.abs(_moved(gradient, a, b, np.nan) - gradient)
            ok = free & _moved(strong, a, b, False) & (_moved(direction, a, b, np.nan) == direction) & (d < near)
        return np.where(ok, d, far)

    chosen, which = np.full(edge.shape, far), np.full(edge.shape, -1)
    for k, (_, a, b) in enumerate(steps):
        d = fits(a, b)
        better = d < chosen
        chosen[better], which[better] = d[better], k
    taken, by = np.full(edge.shape, far), np.full(edge.shape, -1)
    for k, (_, a, b) in enumerate(steps):  # the cell at the opposite offset from the endpoint
        d = np.where(_moved(which, -a, -b, -1) == k, _moved(chosen, -a, -b, far), far)
        better = d < taken
        taken[better], by[better] = d[better], k
    out = edge.copy()
    for k, (_, a, b) in enumerate(steps):
        out |= (which == k) & (_moved(by, a, b, -1) == k)
    return out


def extend_endpoints(pixels: DataFrame, edge: str, endpoint: str, gradient: str, direction: str, size: int = 5, near: float = 25.0, least: float = 25.0, tile: int = TILE) -> DataFrame:
    """(i, j, out): edge cells, and with each endpoint one more cell that goes on in its direction.

    A cell that is no edge, of a gradient of ``least`` or more, chooses the endpoint in its window of the same
    direction, a gradient of ``least`` or more and the least difference of gradient, under ``near``; an endpoint takes
    the cell with the least difference of those that chose it. Of equal differences the nearest counts, then the first
    offset in reading order."""
    layers = {"edge": (pixels, edge), "end": (pixels, endpoint), "gradient": (pixels, gradient), "direction": (pixels, direction)}

    def run(x, at):
        return extended_array(x["edge"] > 0, x["end"] > 0, x["gradient"], x["direction"], size, near, least).astype(float)

    return block_function(layers, run, ["out"], tile, 2 * (size // 2) + 1)
