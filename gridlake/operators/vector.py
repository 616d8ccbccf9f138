"""Vectors: bounding boxes, points in polygons, scan lines, areas, hulls. Polygons are arrays of (x, y) rings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.model import Extent
from gridlake.sources.scratch import written

RING = "array<struct<x:double,y:double>>"
BUNDLE = 256  # rows of equal shape that stand in one array, on average at most
WORK = 1 << 24  # pairs that meet in one task, on average at most


def area(ring: Column) -> Column:
    """Of a ring, open or closed, by the shoelace sum."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def centroid(ring: Column) -> Column:
    """Of a ring, as (x, y); of a ring without area the mean of its corners."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda f: F.aggregate(F.transform(cross, f), F.lit(0.0), lambda s, t: s + t)
    a = total(lambda t: t["c"])
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, t: s + t) / F.size(ring)
    safe = F.when(a != 0, a)
    x = F.coalesce(total(lambda t: t["c"] * t["x"]) / (3 * safe), mean("x"))
    y = F.coalesce(total(lambda t: t["c"] * t["y"]) / (3 * safe), mean("y"))
    return F.struct(x.alias("x"), y.alias("y"))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_max(ys).alias("top"), F.array_max(xs).alias("right"), F.array_min(ys).alias("bottom"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crossed(a, b):
        spans = (a["y"] > y) != (b["y"] > y)
        rise = F.when(spans, b["y"] - a["y"])
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, nxt, crossed), F.lit(0), lambda s, t: s + t) % 2 == 1


def within_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def _bundled(df: DataFrame, by: list[str], rows: Column, name: str) -> DataFrame:
    """``by``, ``name`` (an array of ``rows``, each as ``v``, for arrays take no null) and ``name_id``: rows of equal ``by``, in bundles of about ``BUNDLE``."""
    df = df.select(*by, F.struct(rows.alias("v")).alias(name), F.monotonically_increasing_id().alias("__id"))
    many = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__held")).where(F.col("__held") > BUNDLE)
    bundle = F.coalesce(F.pmod(F.xxhash64("__id"), F.ceil(F.col("__held") / BUNDLE)), F.lit(0)).alias("__bundle")
    out = df.join(many, by, "left").groupBy(*by, bundle).agg(F.collect_list(name).alias(name))
    return written(out.drop("__bundle").withColumn(f"{name}_id", F.monotonically_increasing_id()))


def _met(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """The join of bundles ``a`` and ``b`` on ``on``. Where more than ``WORK`` pairs of rows share a value of it, the
    left bundles are dealt into parts, each of which meets all right ones; tasks are as many as the pairs ask for."""
    p, q = (df.groupBy(*on).agg(F.sum(F.size(c)).cast("double").alias(f"__{c}"), F.count(F.lit(1)).alias(f"__{c}_n")) for df, c in ((left, a), (right, b)))
    work = written(p.join(q, on).withColumn("__work", F.col(f"__{a}") * F.col(f"__{b}")))
    tasks = math.ceil((work.agg(F.sum("__work")).first()[0] or 0) / WORK)
    tasks = min(1 << 15, max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    large = work.where(F.col("__work") > WORK).select(*on, F.least(F.ceil(F.col("__work") / WORK), F.col(f"__{a}_n")).cast("int").alias("__parts"))
    dealt = lambda df: df.join(large, on, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    one = dealt(left).withColumn("__part", F.pmod(F.xxhash64(f"{a}_id"), "__parts").cast("int")).drop("__parts")
    all_ = dealt(right).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return one.repartition(tasks, *on, "__part").join(all_.repartition(tasks, *on, "__part").hint("merge"), [*on, "__part"])


def points_in(points: DataFrame, polygons: DataFrame, key: str, cell: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """Points with the key of each polygon that holds them.

    Polygons are listed under the few square cells that their boxes touch, of size ``cell`` or of the power of two
    times it that is as large as the box, so a large polygon is no long list; points look in their cell of each size
    that some polygon has. The join is on cells; boxes are compared before the ray decides. Equal points and equal
    rings go in bundles, for which the ray decides once, and cells of many pairs are shared by several tasks. Polygons
    without corners and points without coordinates are in none."""
    b = polygons.select(F.col(key).alias("__key"), F.col(ring).alias("__ring")).where(bounds(F.col("__ring"))["left"].isNotNull())
    b = _bundled(b, ["__ring"], F.col("__key"), "__keys").withColumn("__b", bounds(F.col("__ring")))
    wide = F.greatest(F.col("__b.right") - F.col("__b.left"), F.col("__b.top") - F.col("__b.bottom")) / cell
    b = b.withColumn("__level", F.when(wide > 1, F.ceil(F.log2(F.when(wide > 1, wide)))).otherwise(0).cast("int"))
    levels = sorted(r[0] for r in b.select("__level").distinct().collect())
    size = F.pow(F.lit(2.0), F.col("__level")) * cell
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    b = b.withColumn("__ci", F.explode(span("__b.left", "__b.right"))).withColumn("__cj", F.explode(span("__b.bottom", "__b.top")))
    p = points.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.struct(*points.columns).alias("__row")).where("__x is not null and __y is not null")
    p = _bundled(p, ["__x", "__y"], F.col("__row"), "__rows").withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumns({"__ci": F.floor(F.col("__x") / size), "__cj": F.floor(F.col("__y") / size)})
    near = F.col("__x").between(F.col("__b.left"), F.col("__b.right")) & F.col("__y").between(F.col("__b.bottom"), F.col("__b.top"))
    met = _met(p, b, ["__level", "__ci", "__cj"], "__rows", "__keys").where(near).where(inside(F.col("__ring"), F.col("__x"), F.col("__y")))
    return met.select(F.explode("__rows.v").alias("__row"), "__keys").select("__row.*", F.explode("__keys.v").alias(key))


def boxes_overlap(left: DataFrame, right: DataFrame, key: str, other: str, cell: float) -> DataFrame:
    """(key, other) of boxes that share area; ``left`` and ``right``: (key, left, top, right, bottom).

    A pair is reported in the one cell that holds the overlap's lower left corner, so nothing needs to be made distinct.
    Equal boxes go in bundles that are compared once, and cells of many pairs are shared by several tasks."""

    def dealt(df, k, p):
        sides = [p + c for c in ("left", "top", "right", "bottom")]
        d = df.select(F.col(k).alias(f"{p}k"), *(F.col(c[len(p) :]).cast("double").alias(c) for c in sides)).where(F.forall(F.array(*sides), lambda c: c.isNotNull()))
        d = _bundled(d, sides, F.col(f"{p}k"), f"{p}keys")
        d = d.withColumn("ci", F.explode(F.sequence(F.floor(F.col(p + "left") / cell), F.floor(F.col(p + "right") / cell))))
        return d.withColumn("cj", F.explode(F.sequence(F.floor(F.col(p + "bottom") / cell), F.floor(F.col(p + "top") / cell))))

    j = _met(dealt(left, key, "a"), dealt(right, other, "b"), ["ci", "cj"], "akeys", "bkeys")
    shared = (F.col("aleft") < F.col("bright")) & (F.col("bleft") < F.col("aright")) & (F.col("abottom") < F.col("btop")) & (F.col("bbottom") < F.col("atop"))
    home = (F.col("ci") == F.floor(F.greatest("aleft", "bleft") / cell)) & (F.col("cj") == F.floor(F.greatest("abottom", "bbottom") / cell))
    return j.where(shared & home).select(F.explode("akeys.v").alias(key), "bkeys").select(key, F.explode("bkeys.v").alias(other))


def intersecting(left: DataFrame, right: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows of ``left`` whose box shares area with any of ``right``, each once."""
    hit = boxes_overlap(left, right.withColumn("__o", F.monotonically_increasing_id()), key, "__o", cell)
    return left.join(hit.select(key).distinct(), key, "left_semi")


def _touched(polygons: DataFrame, extent: Extent, ring: str) -> DataFrame:
    """(__v, __o, i, j) of the cells that the polygons' edges run through: each edge is cut into the rows it crosses,
    and in each row it covers the columns between where it comes in and where it leaves."""
    rows, cols = extent.shape
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    e = polygons.select("__v", "__o", F.explode(F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    row = lambda c: (F.lit(extent.top) - F.col(c)) / extent.height
    col = lambda c: (F.col(c) - extent.left) / extent.width
    e = e.select("__v", "__o", col("e.a.x").alias("x0"), row("e.a.y").alias("y0"), col("e.b.x").alias("x1"), row("e.b.y").alias("y1"))
    first, last = F.greatest(F.floor(F.least("y0", "y1")), F.lit(0)), F.least(F.floor(F.greatest("y0", "y1")), F.lit(rows - 1))
    none = F.array().cast("array<bigint>")
    e = e.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(none)))
    at = lambda y: F.col("x0") + (F.col("x1") - F.col("x0")) * (F.least(F.greatest(y, F.least("y0", "y1")), F.greatest("y0", "y1")) - F.col("y0")) / F.when(F.col("y1") != F.col("y0"), F.col("y1") - F.col("y0"))
    a, b = F.coalesce(at(F.col("i").cast("double")), F.col("x0")), F.coalesce(at(F.col("i") + 1.0), F.col("x1"))
    j0, j1 = F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.least(F.floor(F.greatest(a, b)), F.lit(cols - 1))
    return e.select("__v", "__o", F.col("i").cast("int").alias("i"), F.explode(F.when(j0 <= j1, F.sequence(j0, j1)).otherwise(none)).alias("j")).withColumn("j", F.col("j").cast("int"))


def rasterized(polygons: DataFrame, extent: Extent, value: str, ring: str = "ring", order: str | None = None, all_touched: bool = False) -> DataFrame:
    """(i, j, value) of cells whose centres a polygon holds, or with ``all_touched`` of all that it covers a part of;
    where several do, the last by ``order``.

    Each polygon is cut into rows, and each row into the spans between its crossings: no cell outside is looked at."""
    rows, cols = extent.shape
    b = bounds(F.col(ring))
    p = polygons.select(F.col(value).alias("__v"), F.col(order or value).alias("__o"), F.col(ring).alias("__r"), b.alias("__b"))
    first = F.greatest(F.lit(0), F.ceil((F.lit(extent.top) - F.col("__b.top")) / extent.height - 0.5)).cast("int")
    last = F.least(F.lit(rows - 1), F.floor((F.lit(extent.top) - F.col("__b.bottom")) / extent.height - 0.5)).cast("int")
    p = p.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    y = extent.y(F.col("i"))
    nxt = F.concat(F.slice("__r", 2, F.size("__r")), F.slice("__r", 1, 1))

    def crossing(a, c):
        spans = (a["y"] > y) != (c["y"] > y)
        return F.when(spans, (c["x"] - a["x"]) * (y - a["y"]) / F.when(spans, c["y"] - a["y"]) + a["x"])

    xs = F.array_sort(F.array_compact(F.zip_with("__r", nxt, crossing)))
    p = p.withColumn("__x", xs).withColumn("__k", F.explode(F.when(F.size("__x") > 1, F.sequence(F.lit(1), F.size("__x") - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))))
    a, z = F.element_at("__x", F.col("__k")), F.element_at("__x", F.col("__k") + 1)
    j0 = F.greatest(F.lit(0), F.floor((a - extent.left) / extent.width - 0.5) + 1).cast("int")
    j1 = F.least(F.lit(cols - 1), F.ceil((z - extent.left) / extent.width - 0.5) - 1).cast("int")
    p = p.withColumn("j", F.explode(F.when(j0 <= j1, F.sequence(j0, j1)).otherwise(F.array().cast("array<int>"))))
    if all_touched:
        edges = polygons.select(F.col(value).alias("__v"), F.col(order or value).alias("__o"), F.col(ring).alias("__r"))
        p = p.select("__v", "__o", "i", "j").unionByName(_touched(edges, extent, "__r"))
    return p.groupBy("i", "j").agg(F.max_by("__v", "__o").alias(value))


def hull(points: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """(group, ring): convex hulls, counter-clockwise from the lowest x.

    In a first pass each task keeps only its own hull's corners of each group, so what meets in one task is small."""

    def corners(p: list[tuple[float, float]]) -> list[tuple[float, float]]:
        p = sorted(set(p))
        if len(p) < 3:
            return p
        out: list[tuple[float, float]] = []
        for line in (p, p[::-1]):
            part: list[tuple[float, float]] = []
            for q in line:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(q)
            out += part[:-1]
        return out

    src = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kind = dict(points.dtypes)[group]

    def partial(batches):
        for pdf in batches:
            for g, part in pdf.groupby("g", dropna=False):
                c = corners(list(zip(part.x, part.y)))
                yield pd.DataFrame({"g": [g] * len(c), "x": [q[0] for q in c], "y": [q[1] for q in c]})

    def final(key, pdf):
        return pd.DataFrame({group: [key[0]], "ring": [[{"x": a, "y": b} for a, b in corners(list(zip(pdf.x, pdf.y)))]]})

    return src.mapInPandas(partial, f"g {kind}, x double, y double").groupBy("g").applyInPandas(final, f"{group} {kind}, ring {RING}")


def utm_zone(longitude: Column, latitude: Column) -> Column:
    """The code of a point's UTM zone: 326zz north, 327zz south."""
    zone = F.floor((longitude + 180) / 6) + 1
    return F.when(latitude >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def to_utm(longitude: Column, latitude: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the usual series, good to centimetres inside the zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    lat, lon = F.radians(latitude), F.radians(longitude - ((zone % 100) * 6 - 183))
    s, c, t = F.sin(lat), F.cos(lat), F.pow(F.tan(lat), F.lit(2.0))
    n = a / F.sqrt(1 - e2 * s * s)
    cc, aa = ep2 * c * c, lon * c
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * lat) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * lat) - (35 * e2**3 / 3072) * F.sin(6 * lat))
    p = lambda x, k: F.pow(x, F.lit(float(k)))
    east = k0 * n * (aa + (1 - t + cc) * p(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * p(aa, 5) / 120) + 500000
    north = k0 * (m + n * F.tan(lat) * (aa * aa / 2 + (5 - t + 9 * cc + 4 * cc * cc) * p(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * p(aa, 6) / 720))
    return east, F.when(zone >= 32700, north + 10000000).otherwise(north)


def square(x: Column, y: Column, half: float) -> Column:
    """The ring of a square around a point."""
    return F.array(*(F.struct((x + a * half).alias("x"), (y + b * half).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def disc(x: Column, y: Column, radius: Column, corners: int = 32) -> Column:
    """The ring of a buffer around a point."""
    return F.array(*(F.struct((x + radius * math.cos(2 * math.pi * k / corners)).alias("x"), (y + radius * math.sin(2 * math.pi * k / corners)).alias("y")) for k in range(corners)))
