"""Points and cells of polygons against loops over all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.model import Extent
from gridlake.operators import focal, vector


def stars(rng, n):
    """Rings of random size, some of them very large."""
    out = []
    for k in range(n):
        c, size = rng.uniform(-20, 120, 2), rng.choice([0.3, 3.0, 20.0, 400.0], p=[0.3, 0.4, 0.25, 0.05])
        t = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        r = size * rng.uniform(0.3, 1, len(t))
        out.append((k, np.c_[c[0] + r * np.cos(t), c[1] + r * np.sin(t)]))
    return out


def holds(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def table(spark, rings):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in r]) for k, r in rings], f"k long, ring {vector.RING}")


def test_points_in_polygons_of_any_size(spark):
    rng = np.random.default_rng(1)
    rings = stars(rng, 60)
    points = [(k, *map(float, rng.uniform(-30, 130, 2))) for k in range(300)]
    p = spark.createDataFrame([*points, (300, None, 1.0)], "p long, x double, y double")
    got = {(r.p, r.k) for r in vector.points_in(p, table(spark, [*rings, (99, [])]), "k", 2.0).collect()}
    assert got == {(n, k) for n, x, y in points for k, r in rings if holds(r, x, y)}
    assert vector.points_in(p, table(spark, []), "k", 2.0).count() == 0


def crosses(a, b, left, right, low, high):
    """Whether a segment runs through an open box, by cutting it at the box's sides."""
    t0, t1, d = 0.0, 1.0, b - a
    for k, (lo, hi) in enumerate(((left, right), (low, high))):
        if d[k] == 0:
            if not lo < a[k] < hi:
                return False
        else:
            u, v = sorted(((lo - a[k]) / d[k], (hi - a[k]) / d[k]))
            t0, t1 = max(t0, u), min(t1, v)
    return t0 < t1


@pytest.mark.parametrize("touched", [False, True])
def test_cells_of_polygons(spark, touched):
    rng = np.random.default_rng(5)
    rings = stars(rng, 12)
    e = Extent(0.0, 90.0, 100.0, 0.0, 2.5, 3.0)
    rows, cols = e.shape
    got = {(r.i, r.j): r.k for r in vector.rasterized(table(spark, rings), e, "k", all_touched=touched).collect()}
    want = {}
    for i in range(rows):
        for j in range(cols):
            left, top = e.corner(i, j)
            for k, r in rings:
                edge = touched and any(crosses(a, b, left, left + 2.5, top - 3.0, top) for a, b in zip(r, np.roll(r, -1, 0)))
                if edge or holds(r, left + 1.25, top - 1.5):
                    want[i, j] = k
    assert got == want


@pytest.mark.parametrize("name", focal.GATHERED)
@pytest.mark.parametrize("size", [3, 5])
def test_gathered_statistics(name, size):
    """Cell by cell, with cells missing and values that tie."""
    rng = np.random.default_rng(2)
    a = np.where(rng.random((13, 11)) < 0.15, np.nan, rng.integers(0, 6, (13, 11)).astype(float) * rng.choice([0.5, 5.0]))
    half, least = size // 2, 7 if size == 3 else 2 * size + 2 * (size - 2)
    got = focal.gathered_kernel(name, a, size, 5.0 if name == "majority" else None)
    for i, j in np.ndindex(a.shape):
        c = a[i, j]
        if np.isnan(c):
            continue
        cell = lambda p, q: a[p, q] if 0 <= p < 13 and 0 <= q < 11 else np.nan
        around = [cell(i + p, j + q) for p in range(-half, half + 1) for q in range(-half, half + 1)]
        others = [v for n, v in enumerate(around) if n != len(around) // 2 and not np.isnan(v)]
        around = [v for v in around if not np.isnan(v)]
        if name == "median":
            want = sorted(around)[len(around) // 2]
        elif name == "majority":
            left = [v for v in around if v != 5.0]
            want = max(left, key=lambda v: (left.count(v), -left.index(v))) if left else 0
        elif name == "duda":
            pairs = [(cell(i + p, j + q), cell(i - p, j - q)) for p, q in ((0, 1), (1, 0), (1, 1), (1, -1))]
            want = max([0, *(2 * c - p - q for p, q in pairs if c > p and c > q)])
        elif name in ("fill-basins", "fill-peaks"):
            side = [v for v in others if (v > c if name == "fill-basins" else v < c)]
            want = np.mean(side) if len(side) >= least else c
        elif name == "remove-min":
            side = [v for v in others if v > 0]
            want = 0 if side and np.mean(side) * 0.1 > c else c
        else:
            want = float(c == 0 or (c < 1.4 and bool(others) and max(others) < 1.4))
        assert got[i, j] == pytest.approx(want), (i, j)


def test_copies_meet_in_bundles_shared_by_tasks(spark, monkeypatch):
    """Copies of points and boxes beyond a bundle, cells of more pairs than a task takes, null keys: nothing is lost,
    and the ray decides once for a bundle."""
    monkeypatch.setattr(vector, "BUNDLE", 4)
    monkeypatch.setattr(vector, "WORK", 50)
    rng = np.random.default_rng(8)
    spots = [(float(k), *map(float, rng.uniform(0, 12, 2))) for k in range(6)]
    points = [(100 * k + n, x, y) for k, (_, x, y) in enumerate(spots) for n in range(11)]
    corners = [(0, 0), (5, 0), (5, 5), (0, 5)]
    rings = [(k if k else None, np.array(corners) + 3.0 * (k % 3)) for k in range(20)]
    polygons = table(spark, rings)
    p = spark.createDataFrame(points, "p long, x double, y double")
    found = vector.points_in(p, polygons, "k", 4.0)
    got = sorted((r.p, r.k or 0) for r in found.collect())
    assert found.columns == ["p", "x", "y", "k"]
    assert got == sorted((n, k or 0) for n, x, y in points for k, r in rings if holds(r, x, y))
    boxes = polygons.select("k", vector.bounds(F.col("ring")).alias("e")).select("k", "e.*")
    found = vector.boxes_overlap(boxes.withColumnRenamed("k", "a"), boxes.withColumnRenamed("k", "b"), "a", "b", 4.0)
    got = sorted((r.a or 0, r.b or 0) for r in found.collect())
    over = lambda r, s: (r.min(0) < s.max(0)).all() and (s.min(0) < r.max(0)).all()
    assert got == sorted((k or 0, n or 0) for k, r in rings for n, s in rings if over(r, s))
    assert found.rdd.getNumPartitions() > 4  # as many tasks as the pairs ask for, not one
