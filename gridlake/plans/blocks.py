"""Queries over blocks: rasters written and read, user functions, regions, outlines, distances, relaxation, warps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridlake.model import Extent
from gridlake.operators import blocks, focal, grid, proximity, regions
from gridlake.sources import raster, scratch
from gridlake.sources import tables as t

QUERIES, ORACLE = {}, {}
_E = "e AS (SELECT event_id // 100 AS i, event_id % 100 AS j, value, list_position(['click','error','purchase','signup','view'], event_type)::INT AS class FROM events)"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {_E} SELECT i, j, class::DOUBLE AS b2, value AS b1 FROM e WHERE j BETWEEN 20 AND 70")
def raster_window(spark, sf_dir):
    """The event grid, written as a raster of two bands and read back by columns."""
    path = scratch.new_path(spark, "raster")
    raster.write_raster(t.event_grid(spark, sf_dir), path, ["value", "class"], block=32, interleave="bil")
    return raster.open_raster(spark, path, [2, 1]).where(F.col("j").between(20, 70))


@query("SELECT k::INT AS band, CASE k WHEN 1 THEN count(*) FILTER (value = 50) ELSE count(*) FILTER (event_type = 'view') END::BIGINT AS cells, 0::BIGINT AS bad FROM events, (SELECT unnest([1, 2]) AS k) GROUP BY k")
def raster_values(spark, sf_dir):
    """How many cells of each band of a written raster hold a value, and how many of its parts can't be read."""
    path = scratch.new_path(spark, "raster")
    raster.write_raster(t.event_grid(spark, sf_dir), path, ["value", "class"], block=32)
    df = raster.open_raster(spark, path)
    held = grid.contains_value(df, ["b1"], 50.0).unionByName(grid.contains_value(df, ["b2"], 5.0))
    return held.select(F.substring("band", 2, 9).cast("int").alias("band"), "cells").join(raster.check_bands(spark, path).select("band", "bad"), "band")


def _contrast(x, at):
    """Value over the mean of the cells within two, and how many of those have the cell's class."""
    near = [np.roll(x["value"], (a, b), (0, 1)) for a in range(-2, 3) for b in range(-2, 3)]
    same = [np.roll(x["class"], (a, b), (0, 1)) == x["class"] for a in range(-2, 3) for b in range(-2, 3)]
    return [x["value"] - np.nansum(near, 0) / np.maximum(np.isfinite(near).sum(0), 1), np.sum(same, 0)]


@query(f"WITH {_E} SELECT a.i, a.j, round(a.value - avg(b.value), 6) AS contrast, sum((a.class = b.class)::INT)::DOUBLE AS same FROM e a JOIN e b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 GROUP BY a.i, a.j, a.value")
def block_contrast(spark, sf_dir):
    e = t.event_grid(spark, sf_dir)
    out = blocks.block_function({"value": (e, "value"), "class": (e, "class")}, _contrast, ["contrast", "same"], 64, 2)
    return out.select("i", "j", F.round("contrast", 6).alias("contrast"), "same")


@query(f"WITH {_E} SELECT 'n' || class AS name, count(*)::DOUBLE AS value FROM e GROUP BY class UNION ALL SELECT 'most', max(value) FROM e")
def block_counts(spark, sf_dir):
    e = t.event_grid(spark, sf_dir)
    part = lambda x, at, own: {f"n{int(c)}": n for c, n in zip(*np.unique(x["class"][own], return_counts=True))} | {"most": x["value"][own].max()}
    return blocks.block_totals({"value": (e, "value"), "class": (e, "class")}, part, {"most": "max"} | {f"n{k}": "sum" for k in range(1, 6)}, 64)


_REGION = f"""WITH RECURSIVE {_E}, n AS (SELECT i, j, class, i * 1073741824 + j AS id FROM e), s AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.class = b.class AND b.id IN (a.id + 1, a.id - 1, a.id + 1073741824, a.id - 1073741824)),
r AS (SELECT id, id AS other FROM n UNION SELECT r.id, s.b FROM r JOIN s ON r.other = s.a), l AS (SELECT id, min(other) AS region FROM r GROUP BY id) """


@query(_REGION + "SELECT i, j, class::DOUBLE AS class, region FROM n JOIN l ON n.id = l.id")
def class_regions(spark, sf_dir):
    return regions.regions(t.event_grid(spark, sf_dir), "class", 64)


@query(_REGION + """, d AS (SELECT unnest([0, 0, 1, -1]) AS di, unnest([1, -1, 0, 0]) AS dj), c AS (SELECT n.id, region, i, j FROM n JOIN l ON n.id = l.id)
SELECT region, count(DISTINCT c.id)::BIGINT AS area, sum((o.region IS DISTINCT FROM c.region)::INT)::BIGINT AS corners FROM (SELECT c.*, i + di AS oi, j + dj AS oj FROM c, d) c LEFT JOIN (SELECT i, j, region FROM c) o ON o.i = oi AND o.j = oj GROUP BY c.region""".replace("SELECT region, count", "SELECT c.region, count"))
def region_outlines(spark, sf_dir):
    """Area and length of each region's outline, from the corners of its rings."""
    rings = regions.outlines(regions.regions(t.event_grid(spark, sf_dir), "class", 64), tile=64)
    return regions.ring_areas(scratch.written(rings)).groupBy("region").agg(F.sum("area").alias("area"), F.sum("corners").alias("corners"))


@query(f"WITH {_E} SELECT a.i, a.j, round(min(sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2))), 6) AS distance FROM e a, (SELECT i, j FROM e WHERE class = 2 AND value > 60) b GROUP BY a.i, a.j")
def distance_to_class(spark, sf_dir):
    return proximity.distance_to(t.event_grid(spark, sf_dir), (F.col("class") == 2) & (F.col("value") > 60)).select("i", "j", F.round("distance", 6).alias("distance"))


_MATRIX = np.array([[0.6, 0.3, 0.1], [0.3, 0.5, 0.2], [0.1, 0.2, 0.7]])
_NEAR = "SELECT a.i, a.j, a.p1, a.p2, a.p3, " + ", ".join(f"(a.p{m} + (1 - 1 / sqrt(2)) * coalesce(sum(b.p{m}), 0)) / (1 + 4 * (1 - 1 / sqrt(2))) AS q{m}" for m in (1, 2, 3)) + " FROM {0} a LEFT JOIN (SELECT i + di AS i, j + dj AS j, p1, p2, p3 FROM {0}, (SELECT unnest([0, 0, 1, -1]) AS di, unnest([1, -1, 0, 0]) AS dj)) b ON a.i = b.i AND a.j = b.j GROUP BY a.i, a.j, a.p1, a.p2, a.p3"
_NEXT = "SELECT i, j, " + ", ".join(f"p{k} * (" + " + ".join(f"{_MATRIX[k - 1][m - 1]} * q{m}" for m in (1, 2, 3)) + f") AS p{k}" for k in (1, 2, 3)) + " FROM {0}"


@query(f"WITH {_E}, p AS (SELECT i, j, CASE WHEN class = 1 THEN 0.7 ELSE 0.15 END::DOUBLE AS p1, CASE WHEN class = 2 THEN 0.7 ELSE 0.15 END::DOUBLE AS p2, CASE WHEN class > 2 THEN 0.7 ELSE 0.15 END::DOUBLE AS p3 FROM e), n1 AS ({_NEAR.format('p')}), r1 AS ({_NEXT.format('n1')}), n2 AS ({_NEAR.format('r1')}), r2 AS ({_NEXT.format('n2')}) SELECT i, j, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM r2")
def focal_plr(spark, sf_dir):
    """Two rounds of label relaxation of three classes."""
    p = t.event_grid(spark, sf_dir).select("i", "j", *(F.when(c, 0.7).otherwise(0.15).alias(n) for n, c in (("p1", F.col("class") == 1), ("p2", F.col("class") == 2), ("p3", F.col("class") > 2))))
    out = focal.moving_window(p, ["p1", "p2", "p3"], "plr", 3, compatibility=_MATRIX, iterations=2, tile=64)
    return out.select("i", "j", *(F.round(c, 9).alias(c) for c in ("p1", "p2", "p3")))


def _warped(spark, sf_dir, how):
    """The event grid on cells of 0.7 by 0.7, where values of 0 to 5 are no data."""
    e = t.event_grid(spark, sf_dir).withColumn("value", F.when(F.col("value") < 5, -1.0).otherwise(F.col("value")))
    rows = e.agg(F.max("i")).first()[0] + 1
    fine = Extent(0.0, float(rows), 99.4, rows - (rows * 10 // 7) * 0.7, 0.7, 0.7)
    out = grid.warp(e, Extent(0.0, float(rows), 100.0, 0.0), fine, "value", how, -1.0)
    return out.select("i", "j", F.round("value", 8).alias("value"))


def _warp_sql(steps, weight):
    return f"""WITH {_E}, g AS (SELECT max(i) + 1 AS n FROM e), c AS (SELECT ti, tj, (tj + 0.5::DOUBLE) * 0.7::DOUBLE - 0.5 AS u, (ti + 0.5::DOUBLE) * 0.7::DOUBLE - 0.5 AS v FROM (SELECT unnest(range(n * 10 // 7)) AS ti FROM g), (SELECT unnest(range(142)) AS tj)),
k AS (SELECT ti, tj, floor(v)::BIGINT + a AS i, floor(u)::BIGINT + b AS j, abs(v - floor(v) - a) AS dv, abs(u - floor(u) - b) AS du FROM c, (SELECT unnest({steps}) AS a), (SELECT unnest({steps}) AS b)),
w AS (SELECT ti, tj, i, j, {weight.format('dv')} * {weight.format('du')} AS w FROM k)
SELECT ti AS i, tj AS j, round(sum(w * value) / sum(w), 8) AS value FROM w JOIN e USING (i, j) WHERE value >= 5 GROUP BY ti, tj HAVING sum(w) > 1e-9"""


@query(_warp_sql("[0, 1]", "(1 - {0})"))
def warp_bilinear(spark, sf_dir):
    return _warped(spark, sf_dir, "bilinear")


@query(_warp_sql("[-1, 0, 1, 2]", "(CASE WHEN {0} <= 1 THEN 1.5 * {0}**3 - 2.5 * {0}**2 + 1 ELSE -0.5 * {0}**3 + 2.5 * {0}**2 - 4 * {0} + 2 END)"))
def warp_cubic(spark, sf_dir):
    return _warped(spark, sf_dir, "cubic")


_THREE = f"{_E}, m AS (SELECT max(i) AS n FROM e), b AS (SELECT i, j, value AS b1, class * 10.0::DOUBLE AS b2, ((i * 7 + j * 3) % 11)::DOUBLE AS b3, class / 5::DOUBLE AS v FROM e)"


def _three(spark, sf_dir):
    e = t.event_grid(spark, sf_dir)
    return e.select("i", "j", F.col("value").alias("b1"), (F.col("class") * 10.0).alias("b2"), ((F.col("i") * 7 + F.col("j") * 3) % 11).cast("double").alias("b3"), (F.col("class") / 5).alias("v"))


@query(f"""WITH {_THREE}, s AS (SELECT a.i, a.j, (a.b1 + a.b2 + a.b3) / 3 * a.v AS c, sum(CASE WHEN a.i <> o.i AND a.j <> o.j THEN 0.7071 ELSE 1 END::DOUBLE * sqrt(pow(a.b1 - o.b1, 2) + pow(a.b2 - o.b2, 2) + pow(a.b3 - o.b3, 2))) AS far,
sum(CASE WHEN a.i <> o.i AND a.j <> o.j THEN 0.7071 ELSE 1 END::DOUBLE * abs(a.v - o.v)) AS differ FROM b a JOIN b o ON o.i BETWEEN a.i - 1 AND a.i + 1 AND o.j BETWEEN a.j - 1 AND a.j + 1 AND (a.i <> o.i OR a.j <> o.j) GROUP BY ALL)
SELECT i, j, CASE WHEN i BETWEEN 1 AND n - 1 AND j BETWEEN 1 AND 98 THEN round(c * far * differ / pow(4 + 4 * 0.7071::DOUBLE, 2), 6) ELSE 0 END AS out FROM s, m""")
def focal_spectral_distance(spark, sf_dir):
    out = focal.moving_window(_three(spark, sf_dir), ["b1", "b2", "b3", "v"], "distance", tile=64)
    return out.select("i", "j", F.round("out", 6).alias("out"))


@query(f"""WITH {_THREE} SELECT a.i, a.j, CASE WHEN a.i BETWEEN 2 AND n - 2 AND a.j BETWEEN 2 AND 97 THEN round(sum(sqrt(pow(a.b1 - o.b1, 2) + pow(a.b2 - o.b2, 2) + pow(a.b3 - o.b3, 2))) / 3, 6) ELSE 0 END AS out
FROM b a JOIN b o ON o.i BETWEEN a.i - 2 AND a.i + 2 AND o.j BETWEEN a.j - 2 AND a.j + 2, m GROUP BY a.i, a.j, n""")
def focal_rgb_distance(spark, sf_dir):
    out = focal.moving_window(_three(spark, sf_dir), ["b1", "b2", "b3"], "rgb-distance", 5, tile=64)
    return out.select("i", "j", F.round("out", 6).alias("out"))
