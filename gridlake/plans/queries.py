"""One query for each operator over the given tables, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import calibration, dates, indices
from gridlake.functions.expressions import expression
from gridlake.model import Extent
from gridlake.operators import accuracy, focal, grid, local_stats, sampling, series, thematic, vector
from gridlake.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

E1 = "e AS (SELECT event_id // 100 AS i, event_id % 100 AS j, value, list_position(['click','error','purchase','signup','view'], event_type)::INT AS class FROM events)"
O1 = "o AS (SELECT o_orderkey // 100 AS i, o_orderkey % 100 AS j, o_totalprice AS price, left(o_orderpriority, 1)::INT AS class FROM orders)"
M1 = "m AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS bands FROM embeddings), b AS (SELECT vec_id, label, bands, " + ", ".join(f"bands[{k}] AS {n}" for k, n in enumerate(t.BANDS, 1)) + " FROM m)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# spectral indices

_ND = "({b} - {a}) / nullif({b} + {a}, 0)"
_CLIP = "least(greatest({}, -1.0), 1.0)"
_EVI2 = "2.5 * (nir - red) / nullif(nir + 1 + 2.4 * red, 0)"
_SOIL = "(nir - red) / nullif(nir + red + 1, 0) * 2"
_INDEX_SQL = {
    "ARVI": "(nir - (red - (blue - red))) / nullif(nir + (red - (blue - red)), 0)",
    "BRIGHT": "least(sqrt(green*green + red*red + nir*nir + midir*midir), 1.0)",
    "CBI": _CLIP.format(_ND.format(a="cblue", b="blue")),
    "CIRE": _CLIP.format("rededge3 / nullif(rededge, 0) - 1"),
    "EVI": "least(greatest(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0), 0.0), 1.0)",
    "EVI2": f"least(greatest({_EVI2}, 0.0), 1.0)",
    "IPVI": "nir / nullif(nir + red, 0)",
    "GNDVI": _CLIP.format(_ND.format(a="green", b="nir")),
    "MNDWI": _CLIP.format(_ND.format(a="midir", b="green")),
    "MSAVI": "((2*nir+1) - sqrt(greatest((2*nir+1)*(2*nir+1) - 8*(nir-red), 0))) / 2",
    "NDSI": _CLIP.format(_ND.format(a="nir", b="midir")),
    "NDBAI": _CLIP.format(_ND.format(a="midir", b="farir")),
    "NBRI": _CLIP.format(_ND.format(a="farir", b="nir")),
    "NDII": _CLIP.format("(farir - midir + {v}) / nullif(farir + midir + {v}, 0)".format(v=_CLIP.format(_ND.format(a="red", b="nir")))),
    "NDVI": _CLIP.format(_ND.format(a="red", b="nir")),
    "RENDVI": _CLIP.format(_ND.format(a="rededge", b="nir")),
    "ONDVI": "atan((nir - red) / nullif(nir + red, 0)) * 4 / pi()",
    "NDWI": _CLIP.format(_ND.format(a="nir", b="green")),
    "PNDVI": _CLIP.format(_ND.format(a="green", b="red")),
    "RBVI": _CLIP.format(_ND.format(a="blue", b="red")),
    "GBVI": _CLIP.format(_ND.format(a="blue", b="green")),
    "SATVI": "(midir - red) / nullif(midir + red + 1, 0) * 2 - farir / 2",
    "SAVI": _SOIL,
    "OSAVI": f"atan({_SOIL} / 1.5) * 2",
    "SVI": "nir / nullif(red, 0)",
    "TNDVI": "CASE WHEN nir >= red THEN sqrt((nir - red) / nullif(nir + red, 0) * 0.5) ELSE 0 END",
    "TVI": "CASE WHEN (nir - green) / nullif(nir + green, 0) + 0.5 >= 0 THEN sqrt((nir - green) / nullif(nir + green, 0) + 0.5) ELSE 0 END",
    "TWVI": "least(greatest(((({s}+1)/2) - (({e}+1)/2)) / nullif((({s}+1)/2) + (({e}+1)/2), 0), -1.0), 1.0)".format(s=_CLIP.format("(midir - nir) / nullif(midir + nir, 0)"), e=f"least(greatest({_EVI2}, 0.0), 1.0)"),
    "YNDVI": _CLIP.format(_ND.format(a="yellow", b="nir")),
    "VISMU": "least((blue + green + red) / 3, 1.0)",
    "WI": "CASE WHEN red + midir > 0.5 THEN 0 ELSE 1 - (red + midir) / 0.5 END",
}


def _index_query(name: str) -> Query:
    def run(spark, sf_dir):
        m = t.reflectances(spark, sf_dir)
        m = m.withColumn("ndvi", indices.index("NDVI", F.col("red"), F.col("nir"), in_no_data=None))
        return m.select("vec_id", _r(indices.index(name, *map(F.col, indices.INDICES[name].bands), in_no_data=None)).alias("value"))

    return run


for _n, _sql in _INDEX_SQL.items():
    QUERIES[f"index_{_n.lower()}"] = _index_query(_n)
    ORACLE[f"index_{_n.lower()}"] = f"WITH {M1} SELECT vec_id, round(coalesce({_sql}, 0)::DOUBLE, 6) AS value FROM b"


@query(f"WITH {M1}, n AS (SELECT vec_id, least(greatest((nir-red)/nullif(nir+red,0),-1),1) AS v FROM b), r AS (SELECT greatest(min(v),0) AS lo, greatest(max(v),0) AS hi FROM n) SELECT b.vec_id, round(((nir-red)/nullif(nir+red,0) - lo) / (hi - lo), 6) AS value FROM b, r")
def index_vci(spark, sf_dir):
    return indices.condition_index(t.reflectances(spark, sf_dir), "red", "nir", "value", in_no_data=None).select("vec_id", _r("value").alias("value"))


@query(f"WITH {M1} SELECT vec_id, floor((least(greatest((nir-red)/nullif(nir+red,0),-1),1)+1)*127)::INT AS value FROM b")
def index_rescaled(spark, sf_dir):
    v = indices.index("NDVI", F.col("red"), F.col("nir"), in_no_data=None, rescale=(0, 254))
    return t.reflectances(spark, sf_dir).select("vec_id", v.cast("int").alias("value"))


@query(f"WITH {E1}, {O1}, n AS (SELECT i, j, (price/1000 - value)/nullif(price/1000 + value, 0) AS v FROM e JOIN o USING (i, j)) SELECT i//10 AS bi, j//10 AS bj, round(avg(least(greatest(v,-1),1)), 6) AS ndvi FROM n GROUP BY 1, 2")
def ndvi_blocks(spark, sf_dir):
    """Scan, overlay, index, block means."""
    a, b = t.event_grid(spark, sf_dir), t.order_grid(spark, sf_dir)
    g = a.select("i", "j", "value").join(b.select("i", "j", (F.col("price") / 1000).alias("price")), ["i", "j"])
    n = g.select("i", "j", indices.index("NDVI", F.col("value"), F.col("price"), in_no_data=None).alias("v"))
    return focal.block_statistic(n, "v", 10).select(F.col("i").alias("bi"), F.col("j").alias("bj"), _r("out").alias("ndvi"))


# map algebra


@query(f"WITH {E1}, {O1} SELECT i, j, round(CASE WHEN value > 50 THEN sqrt(price) ELSE value * 2 END, 6) AS b1, (CASE WHEN e.class = 2 AND o.class < 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS b2 FROM e JOIN o USING (i, j)")
def raster_calc(spark, sf_dir):
    a, b = t.event_grid(spark, sf_dir), t.order_grid(spark, sf_dir)
    g = a.withColumnRenamed("class", "ca").join(b.withColumnRenamed("class", "cb"), ["i", "j"])
    names = {n: F.col(n) for n in ("value", "price", "ca", "cb")}
    one, two = expression("where(value > 50, sqrt(price), value * 2)", names), expression("where((ca == 2) & (cb < 3), 1, 0)", names)
    return g.select("i", "j", _r(one).alias("b1"), two.alias("b2"))


@query(f"WITH {E1}, {O1}, c AS (SELECT e.i - 2 AS i, e.j - 5 AS j, value FROM e WHERE e.i BETWEEN 2 AND 7 AND e.j BETWEEN 5 AND 54), d AS (SELECT i, j, price FROM o WHERE i < 6 AND j < 50) SELECT i, j, round(price - value, 6) AS b1 FROM c JOIN d USING (i, j)")
def overlay_extents(spark, sf_dir):
    a, b = t.event_grid(spark, sf_dir), t.order_grid(spark, sf_dir)
    whole, part = Extent(0, 10, 100, 0), Extent(5, 8, 55, 2)
    out = grid.calculate({"v": (a, whole, "value"), "p": (b, part, "price")}, "p - v")
    return out.select("i", "j", _r("b1").alias("b1"))


@query(f"WITH {E1} SELECT i, j, value FROM e WHERE i BETWEEN 3 AND 7 AND j BETWEEN 10 AND 39")
def window_read(spark, sf_dir):
    return grid.window(t.event_grid(spark, sf_dir), 3, 10, 5, 30, ["value"])


@query(f"WITH {M1} SELECT vec_id, u.k AS band, round(bands[u.k], 6) AS value FROM b, unnest(range(1, 65)) AS u(k)")
def samples_long(spark, sf_dir):
    m = t.reflectances(spark, sf_dir).select(F.col("vec_id").alias("i"), F.lit(0).alias("j"), "bands")
    return grid.long_form(m).select(F.col("i").alias("vec_id"), F.col("band").cast("bigint").alias("band"), _r("value").alias("value"))


@query(f"WITH {E1} SELECT 'value' AS band, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std FROM e UNION ALL SELECT 'class', min(class), max(class), round(avg(class), 6), round(stddev_pop(class), 4) FROM e")
def band_statistics(spark, sf_dir):
    s = grid.statistics(t.event_grid(spark, sf_dir), ["value", "class"])
    return s.select("band", "min", "max", _r("mean").alias("mean"), _r("std", 4).alias("std"))


@query(f"WITH {E1} SELECT round(count(*) FILTER (class = 1) * 100.0 / count(*) FILTER (class <> 5), 6)::DOUBLE AS clear_percent FROM e")
def clear_percent(spark, sf_dir):
    return grid.clear_share(t.event_grid(spark, sf_dir), "class", 1, 5).select(_r("clear_percent").alias("clear_percent"))


@query(f"WITH {E1} SELECT i//4 AS i, j//4 AS j, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def overviews_mean(spark, sf_dir):
    return grid.pyramid(t.event_grid(spark, sf_dir), "value", 4, "mean").select("i", "j", _r("value").alias("value"))


@query(f"WITH {E1} SELECT i//2 AS i, j//2 AS j, value FROM e WHERE i % 2 = 0 AND j % 2 = 0")
def overviews_nearest(spark, sf_dir):
    return grid.pyramid(t.event_grid(spark, sf_dir), "value", 2)


@query(f"WITH {E1}, {O1} SELECT i, j, coalesce(CASE WHEN p > 200000 THEN p END, v) AS value FROM (SELECT i, j, value AS v, price AS p FROM e FULL JOIN o USING (i, j))")
def mosaic_layers(spark, sf_dir):
    a = t.event_grid(spark, sf_dir).select("i", "j", "value")
    b = t.order_grid(spark, sf_dir).select("i", "j", F.when(F.col("price") > 200000, F.col("price")).alias("value")).where("value is not null")
    full = grid.mosaic([a, b], "value", None)
    gone = t.order_grid(spark, sf_dir).select("i", "j").join(full.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(None).cast("double").alias("value"))
    return full.unionByName(gone)


@query(f"WITH {E1}, {O1}, x AS (SELECT i, j, CASE WHEN class = 2 THEN 0.0 ELSE value END AS value FROM e) SELECT i, j, CASE WHEN x.value IS NULL OR (x.value = 0 AND o.price IS NOT NULL) THEN o.price ELSE x.value END AS value FROM x FULL JOIN o USING (i, j)")
def fill_only_update(spark, sf_dir):
    a = t.event_grid(spark, sf_dir).select("i", "j", F.when(F.col("class") == 2, 0.0).otherwise(F.col("value")).alias("value"))
    return grid.filled_where_empty(a, t.order_grid(spark, sf_dir).select("i", "j", F.col("price").alias("value")), "value")


@query(f"WITH {E1}, {O1} SELECT i, j, CASE WHEN o.i IS NULL THEN 0.0 ELSE value END AS value FROM e LEFT JOIN (SELECT i, j FROM o WHERE class <= 2) o USING (i, j)")
def mask_by_layer(spark, sf_dir):
    return grid.masked(t.event_grid(spark, sf_dir), t.order_grid(spark, sf_dir).where("class <= 2"), "value").select("i", "j", "value")


def _event_extent(a, cell: float = 1.0) -> Extent:
    """The whole grid of the events: 100 columns, and rows up to the last event."""
    rows = a.agg(F.max("i")).first()[0] + 1
    return Extent(0, rows, 100, 0, cell, cell)


@query(f"WITH {E1} SELECT i//2 AS i, j//2 AS j, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def resample_mean(spark, sf_dir):
    a = t.event_grid(spark, sf_dir)
    return grid.resample(a, _event_extent(a), _event_extent(a, 2.0), "value", "mean").select("i", "j", _r("value").alias("value"))


@query(f"WITH {E1} SELECT i*2 + a AS i, j*2 + b AS j, value FROM e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(a, b)")
def resample_nearest(spark, sf_dir):
    a = t.event_grid(spark, sf_dir)
    return grid.resample(a, _event_extent(a), _event_extent(a, 0.5), "value")


@query(f"WITH {E1} SELECT i - 2 AS i, j - 4 AS j, trunc(value / 500 * 255)::INT AS value FROM e WHERE i BETWEEN 2 AND 5 AND j BETWEEN 4 AND 63")
def translate_window(spark, sf_dir):
    return grid.translate(t.event_grid(spark, sf_dir), "value", 2, 4, 4, 60, (0, 500, 0, 255), "int")


@query(f"WITH {M1} SELECT vec_id, round(blue * nir / nullif(blue/3 + green/3 + red/3, 0), 6) AS blue, round(green * nir / nullif(blue/3 + green/3 + red/3, 0), 6) AS green, round(red * nir / nullif(blue/3 + green/3 + red/3, 0), 6) AS red FROM b")
def pan_sharpen(spark, sf_dir):
    out = grid.pan_sharpen(t.reflectances(spark, sf_dir), ["blue", "green", "red"], "nir")
    return out.select("vec_id", *(_r(b).alias(b) for b in ("blue", "green", "red")))


# statistics over bands

_STAT_SQL = {
    "min": "list_min(bands)", "max": "list_max(bands)", "mean": "list_avg(bands)", "median": "list_median(bands)", "var": "list_var_pop(bands)", "std": "list_stddev_pop(bands)", "cv": "list_stddev_pop(bands) / list_avg(bands)", "sum": "list_sum(bands)",
}


def _stat_query(name: str) -> Query:
    def run(spark, sf_dir):
        m = local_stats.pixel_stat(t.reflectances(spark, sf_dir), "bands", name, "value")
        return m.select("vec_id", _r("value").alias("value"))

    return run


for _n, _sql in _STAT_SQL.items():
    QUERIES[f"pixel_{_n}"] = _stat_query(_n)
    ORACLE[f"pixel_{_n}"] = f"WITH {M1} SELECT vec_id, round({_sql.replace('list_var_pop(bands)', 'list_aggregate(bands, ' + chr(39) + 'var_pop' + chr(39) + ')').replace('list_stddev_pop(bands)', 'list_aggregate(bands, ' + chr(39) + 'stddev_pop' + chr(39) + ')')}, 6) AS value FROM b"


@query(f"WITH {M1}, x AS (SELECT vec_id, floor(unnest(bands) * 10) AS v FROM b), c AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY 1, 2) SELECT vec_id, arg_max(v, n * 1000 - v)::DOUBLE AS value FROM c GROUP BY 1")
def pixel_mode(spark, sf_dir):
    m = t.reflectances(spark, sf_dir).withColumn("bands", F.transform("bands", lambda v: F.floor(v * 10).cast("double")))
    return local_stats.pixel_stat(m, "bands", "mode", "value").select("vec_id", "value")


@query(f"WITH {M1} SELECT vec_id, round((nir - avg(nir) OVER ()) / stddev_pop(nir) OVER (), 5) AS value FROM b")
def pixel_zscore(spark, sf_dir):
    return local_stats.zscores(t.reflectances(spark, sf_dir), ["nir"]).select("vec_id", _r("nir_z", 5).alias("value"))


@query(
    f"WITH {M1} SELECT vec_id, round(list_avg(bands), 6) AS mean, round(list_aggregate(bands, 'stddev_pop') / list_avg(bands), 6) AS cv, "
    + ", ".join(f"round(list_aggregate(bands, 'quantile_cont', {p}), 6) AS {n}" for n, p in (("five", 0.05), ("twenty_five", 0.25), ("fifty", 0.5), ("seventy_five", 0.75), ("ninety_five", 0.95)))
    + ", "
    + ", ".join(f"round(list_sum(bands[1:{k}]), 6) AS {n}_cumulative" for n, k in (("five", 5), ("twenty_five", 17), ("fifty", 33), ("seventy_five", 49), ("ninety_five", 62)))
    + ", round(list_max([abs(bands[k+1] - 2*bands[k] + bands[k-1]) for k in range(2, 64)]), 6) AS max_diff FROM b"
)
def series_features(spark, sf_dir):
    names = [n for n in local_stats.FEATURES if "slope" not in n]
    m = local_stats.series_features(t.reflectances(spark, sf_dir).select("vec_id", "bands"), "bands", names)
    return m.select("vec_id", *(_r(n).alias(n) for n in names))


@query(f"WITH {M1}, x AS (SELECT vec_id, u.k AS t, bands[u.k] AS v FROM b, unnest(range(1, 65)) AS u(k)), s AS (SELECT vec_id, t, regr_slope(v, t) OVER w AS s, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) SELECT vec_id, round(min(s), 6) AS min_slope, round(max(s), 6) AS max_slope FROM s WHERE n = 15 GROUP BY 1")
def series_slopes(spark, sf_dir):
    m = local_stats.series_features(t.reflectances(spark, sf_dir).select("vec_id", "bands"), "bands", ["min_slope", "max_slope"])
    return m.select("vec_id", _r("min_slope").alias("min_slope"), _r("max_slope").alias("max_slope"))


# windows in order

_ROLL = "SELECT event_id, user_id, value FROM events"


def _rolling_query(how: str) -> Query:
    def run(spark, sf_dir):
        e = t.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
        return series.rolling(e, "value", ["user_id"], ["event_id"], 5, how, out="out").select("event_id", _r("out").alias("out"))

    return run


for _n, _f in {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "min": "min(value)", "max": "max(value)"}.items():
    QUERIES[f"rolling_{_n}"] = _rolling_query(_n)
    ORACLE[f"rolling_{_n}"] = f"SELECT event_id, round({_f} OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS out FROM events"


@query("WITH x AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events), s AS (SELECT event_id, regr_slope(value, t) OVER w AS s, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT event_id, CASE WHEN n = 5 THEN round(s, 5) END AS out FROM s")
def rolling_slope(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return series.rolling(e, "value", ["user_id"], ["event_id"], 5, "slope", out="out").select("event_id", _r("out", 5).alias("out"))


@query("WITH s AS (SELECT event_id, lag(value) OVER w AS a, value AS b, lead(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(a * 0.25 + b * 0.5 + c * 0.25, 6) AS out FROM s")
def rolling_convolve(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return series.rolling(e, "value", ["user_id"], ["event_id"], 3, "convolve", weights=[0.25, 0.5, 0.25], out="out").select("event_id", _r("out").alias("out"))


@query("""WITH x AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events),
g AS (SELECT *, CASE WHEN v <> 0 THEN v END AS good, CASE WHEN v <> 0 THEN t END AS pos FROM x),
n AS (SELECT *, last_value(good IGNORE NULLS) OVER p AS a, last_value(pos IGNORE NULLS) OVER p AS ta, first_value(good IGNORE NULLS) OVER f AS b, first_value(pos IGNORE NULLS) OVER f AS tb, max(v) OVER (PARTITION BY user_id) AS top FROM g
  WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN top > 0 THEN coalesce(good, CASE WHEN tb > ta THEN a + (b - a) * (t - ta) / (tb - ta) END, a, b) ELSE v END, 6) AS filled FROM n""")
def interpolate_gaps(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("v"))
    return series.interpolate(e, "v", ["user_id"], "event_id", 0.0, "filled").select("event_id", _r("filled").alias("filled"))


# focal windows

_BOX = "WITH {e}, n AS (SELECT a.i, a.j, a.value AS c, b.value AS v, b.i - a.i AS di, b.j - a.j AS dj FROM e a JOIN e b ON b.i BETWEEN a.i - {h} AND a.i + {h} AND b.j BETWEEN a.j - {h} AND a.j + {h}), s AS (SELECT max(i) AS mi, max(j) AS mj FROM e), f AS (SELECT i, j, {f} AS v FROM n GROUP BY i, j) SELECT i, j, CASE WHEN i BETWEEN {h} AND mi - {h} AND j BETWEEN {h} AND mj - {h} THEN round(v, {d}) ELSE 0 END::DOUBLE AS out FROM f, s"


def _focal_query(statistic: str, size: int, digits: int) -> Query:
    def run(spark, sf_dir):
        out = focal.moving_window(t.event_grid(spark, sf_dir), "value", statistic, size)
        return out.select("i", "j", _r("out", digits).alias("out"))

    return run


_FOCAL_SQL = {
    "sum": (5, "sum(v)", 5), "mean": (5, "avg(v)", 6), "min": (3, "min(v)", 6), "max": (3, "max(v)", 6), "percent": (3, "avg(v) * 100", 5), "std": (3, "stddev_pop(v)", 4), "median": (3, "list_sort(list(v))[count(*)//2 + 1]", 6),
    "fill-basins": (3, "CASE WHEN count(*) FILTER (v > c) >= 7 THEN avg(v) FILTER (v > c) ELSE any_value(c) END", 6),
    "fill-peaks": (3, "CASE WHEN count(*) FILTER (v < c) >= 7 THEN avg(v) FILTER (v < c) ELSE any_value(c) END", 6),
    "remove-min": (3, "CASE WHEN avg(v) FILTER (v > 0 AND (di <> 0 OR dj <> 0)) * 0.1 > any_value(c) THEN 0 ELSE any_value(c) END", 6),
    "seg-dist": (3, "CASE WHEN any_value(c) = 0 OR (any_value(c) < 1.4 AND max(v) FILTER (di <> 0 OR dj <> 0) < 1.4) THEN 1 ELSE 0 END", 6),
    "duda": (3, "greatest(0, " + ", ".join(f"CASE WHEN any_value(c) > max(v) FILTER (di = {a} AND dj = {b}) AND any_value(c) > max(v) FILTER (di = {-a} AND dj = {-b}) THEN 2 * any_value(c) - max(v) FILTER (di = {a} AND dj = {b}) - max(v) FILTER (di = {-a} AND dj = {-b}) ELSE 0 END" for a, b in ((0, -1), (-1, 0), (-1, -1), (-1, 1))) + ")", 5),
}
for _n, (_size, _f, _d) in _FOCAL_SQL.items():
    _q = f"focal_{_n.replace('-', '_')}"
    QUERIES[_q] = _focal_query(_n, _size, _d)
    ORACLE[_q] = _BOX.format(e=E1, h=_size // 2, f=_f, d=_d)
for _n in focal.TILED:
    QUERIES[f"focal_{_n.replace('-', '_')}"] = _focal_query(_n, 5, 6)


@query(f"WITH {E1}, n AS (SELECT a.i, a.j, b.class AS v, (b.i - a.i) * 10 + b.j - a.j AS pos FROM e a JOIN e b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1), c AS (SELECT i, j, v, count(*) AS k, min(pos) AS first FROM n GROUP BY 1, 2, 3), m AS (SELECT i, j, arg_max(v, k * 1000 - first) AS v FROM c GROUP BY 1, 2), s AS (SELECT max(i) AS mi, max(j) AS mj FROM e) SELECT i, j, (CASE WHEN i BETWEEN 1 AND mi - 1 AND j BETWEEN 1 AND mj - 1 THEN v ELSE 0 END)::DOUBLE AS out FROM m, s")
def focal_majority(spark, sf_dir):
    return focal.moving_window(t.event_grid(spark, sf_dir), "class", "majority", 3)


@query(f"WITH {E1} SELECT i//7 AS i, j//7 AS j, round(avg(value), 6) AS out FROM e GROUP BY 1, 2")
def focal_skip_blocks(spark, sf_dir):
    return focal.block_statistic(t.event_grid(spark, sf_dir), "value", 7).select("i", "j", _r("out").alias("out"))


@query(f"WITH {E1} SELECT a.i, a.j, max((b.class > 4)::INT)::DOUBLE AS out FROM e a JOIN e b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY 1, 2")
def morphology_expand(spark, sf_dir):
    e = t.event_grid(spark, sf_dir).withColumn("v", (F.col("class") > 4).cast("double"))
    return focal.expanded(e, "v")


@query(f"WITH {E1} SELECT a.i, a.j, min((b.class > 1)::INT)::DOUBLE AS out FROM e a JOIN e b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY 1, 2")
def morphology_shrink(spark, sf_dir):
    e = t.event_grid(spark, sf_dir).withColumn("v", (F.col("class") > 1).cast("double"))
    return focal.shrunk(e, "v")


@query(f"WITH {E1}, g AS (SELECT i, j, value, lag(value) OVER x AS xa, lead(value) OVER x AS xb, lag(value) OVER y AS ya, lead(value) OVER y AS yb FROM e WINDOW x AS (PARTITION BY i ORDER BY j), y AS (PARTITION BY j ORDER BY i)), h AS (SELECT i, j, CASE WHEN xa IS NULL THEN xb - value WHEN xb IS NULL THEN value - xa ELSE (xb - xa)/2 END AS gx, CASE WHEN ya IS NULL THEN yb - value WHEN yb IS NULL THEN value - ya ELSE (yb - ya)/2 END AS gy FROM g) SELECT i, j, round(degrees(atan(sqrt(coalesce(gx,0)*coalesce(gx,0) + coalesce(gy,0)*coalesce(gy,0)))), 5) AS slope FROM h")
def terrain_slope(spark, sf_dir):
    return focal.slope(t.event_grid(spark, sf_dir), "value").select("i", "j", _r("slope", 5).alias("slope"))


# class maps


@query(f"WITH {E1} SELECT i, j, CASE class WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 9 ELSE class END AS class FROM e")
def reclassify_values(spark, sf_dir):
    return t.event_grid(spark, sf_dir).select("i", "j", thematic.reclassify(F.col("class"), {1: 2, 2: 1, 5: 9}).alias("class"))


@query(f"WITH {E1} SELECT i, j, CASE WHEN j < 50 AND class IN (1, 2) THEN 3 WHEN j >= 50 AND class = 4 THEN 5 ELSE class END AS class FROM e")
def recode_zones(spark, sf_dir):
    e = t.event_grid(spark, sf_dir).withColumn("zone", (F.col("j") >= 50).cast("int"))
    return thematic.recode(e, "class", "zone", {0: [(1, 2), (2, 3)], 1: [(4, 5)]}).select("i", "j", "class")


@query(f"WITH {E1}, {O1}, p AS (SELECT e.class AS a, o.class AS b FROM e JOIN o USING (i, j)), c AS (SELECT DISTINCT a AS c FROM p), g AS (SELECT x.c AS f, y.c AS t FROM c x, c y) SELECT f AS from_class, t AS to_class, row_number() OVER (ORDER BY f, t) AS change, (SELECT count(*) FROM p WHERE a = f AND b = t) AS count FROM g")
def change_matrix(spark, sf_dir):
    p = t.event_grid(spark, sf_dir).select("i", "j", F.col("class").alias("a")).join(t.order_grid(spark, sf_dir).select("i", "j", F.col("class").alias("b")), ["i", "j"])
    return thematic.change_matrix(p, "a", "b")


@query(f"WITH {E1}, {O1}, p AS (SELECT i, j, e.class AS a, o.class AS b FROM e JOIN o USING (i, j)), c AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT a AS c FROM p)) SELECT i, j, (x.k - 1) * (SELECT count(*) FROM c) + y.k AS change FROM p JOIN c x ON x.c = a LEFT JOIN c y ON y.c = b")
def change_map(spark, sf_dir):
    p = t.event_grid(spark, sf_dir).select("i", "j", F.col("class").alias("a")).join(t.order_grid(spark, sf_dir).select("i", "j", F.col("class").alias("b")), ["i", "j"])
    return thematic.change_map(p, "a", "b").select("i", "j", F.col("change").cast("bigint").alias("change"))


@query("WITH h AS (SELECT least(floor(value * 20 / 500), 19)::INT AS bin, count(*) AS count FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1) SELECT bin, count, round(CASE WHEN bin <> 0 THEN count * 100.0 / sum(count) FILTER (bin <> 0) OVER () END, 6)::DOUBLE AS percent FROM h")
def histogram(spark, sf_dir):
    h = thematic.histogram(t.table(spark, sf_dir, "events"), "value", 20, 0.0, 500.0)
    return h.select("bin", "count", _r("percent").alias("percent"))


@query()
def histogram_matching(spark, sf_dir):
    e = t.event_grid(spark, sf_dir).withColumn("value", F.least(F.col("value"), F.lit(255.0)))
    o = t.order_grid(spark, sf_dir).withColumn("value", F.col("price") / 2000)
    return thematic.match_histogram(e, o, "value").select("i", "j", _r("matched").alias("matched"))


@query("WITH c AS (SELECT user_id, length(event_type) AS label, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(label, n * 100 - label)::INT AS majority, max(n) AS votes FROM c GROUP BY 1")
def stack_majority(spark, sf_dir):
    v = t.table(spark, sf_dir, "events").select("user_id", F.length("event_type").alias("label"))
    return thematic.majority(v, ["user_id"], "label")


# accuracy

_P = f"WITH {E1}, {O1}, p AS (SELECT e.class AS a, o.class AS b FROM e JOIN o USING (i, j)), x AS (SELECT a AS predicted, b AS observed, count(*) AS n FROM p GROUP BY 1, 2)"
_C = ", c AS (SELECT c AS class, coalesce(sum(n) FILTER (predicted = observed AND predicted = c), 0) AS h, coalesce(sum(n) FILTER (predicted = c), 0) AS r, coalesce(sum(n) FILTER (observed = c), 0) AS k FROM x, (SELECT predicted AS c FROM x UNION SELECT observed FROM x) GROUP BY 1)"


def _matrix(spark, sf_dir):
    p = t.event_grid(spark, sf_dir).select("i", "j", F.col("class").alias("a")).join(t.order_grid(spark, sf_dir).select("i", "j", F.col("class").alias("b")), ["i", "j"])
    return accuracy.confusion(p, "a", "b")


@query(_P + " SELECT predicted, observed, n FROM x")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(_P + _C + " SELECT class, round(coalesce(h / nullif(k, 0), 0) * 100, 6)::DOUBLE AS producers, round(coalesce(h / nullif(r, 0), 0) * 100, 6)::DOUBLE AS users, round(coalesce(2 * h / nullif(r + k, 0), 0), 6)::DOUBLE AS f1, round(coalesce(1.25 * h / nullif(0.25 * k + r, 0), 0), 6)::DOUBLE AS f_beta FROM c")
def class_accuracy(spark, sf_dir):
    out = accuracy.by_class(_matrix(spark, sf_dir))
    return out.select("class", *(_r(c).alias(c) for c in ("producers", "users", "f1", "f_beta")))


@query(_P + _C + ", t AS (SELECT sum(h)::DOUBLE AS h, sum(r)::DOUBLE AS n, sum(r::DOUBLE * k) AS cross_ FROM c) SELECT n::BIGINT AS n, round(h / n * 100, 6) AS overall, round(1 - h / n, 6) AS hamming_loss, round((h/n - cross_/n/n) / (1 - cross_/n/n), 6) AS kappa FROM t")
def accuracy_summary(spark, sf_dir):
    out = accuracy.summary(_matrix(spark, sf_dir))
    return out.select("n", *(_r(c).alias(c) for c in ("overall", "hamming_loss", "kappa")))


@query(_P + ", r AS (SELECT predicted, sum(n) AS r FROM x GROUP BY 1), k AS (SELECT observed, sum(n) AS k FROM x GROUP BY 1), g AS (SELECT power(predicted - observed, 2) AS w, r::DOUBLE * k / (SELECT sum(n) FROM x) AS e, coalesce(n, 0) AS n FROM (SELECT * FROM r, k) LEFT JOIN x USING (predicted, observed)) SELECT round(1 - sum(w * n) / sum(w * e), 6) AS kappa FROM g")
def kappa_quadratic(spark, sf_dir):
    return accuracy.kappa(_matrix(spark, sf_dir), "quadratic").select(_r("kappa").alias("kappa"))


@query("SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e*e), 4) AS mse, round(quantile_cont(abs(e), 0.5), 6) AS medae, round(sqrt(avg(e*e)), 5) AS rmse, round(1 - avg(e*e) / var_pop(p_retailprice), 6) AS r2 FROM (SELECT p_size * 30.0 - p_retailprice AS e, p_retailprice FROM part)")
def regression_errors(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select((F.col("p_size") * 30.0).alias("a"), F.col("p_retailprice").alias("b"))
    out = accuracy.regression(p, "a", "b")
    return out.select("n", _r("mae").alias("mae"), _r("mse", 4).alias("mse"), _r("medae").alias("medae"), _r("rmse", 5).alias("rmse"), _r("r2").alias("r2"))


@query("WITH a AS (SELECT o_orderpriority, sum(o_totalprice) AS area, avg((o_orderstatus = 'F')::INT) AS users FROM orders GROUP BY 1) SELECT round(pow(sum(area / (SELECT sum(area) FROM a) * sqrt(users * (1 - users))) / 0.01, 2))::BIGINT AS samples FROM a")
def sample_size(spark, sf_dir):
    a = t.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("area"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("users"))
    return accuracy.sample_size(a, "area", "users", 0.01)


@query(_P + ", w AS (SELECT predicted, sum(n)::DOUBLE AS r, sum(n) * predicted::DOUBLE AS m FROM x GROUP BY 1), s AS (SELECT observed, n / r AS q, m / (SELECT sum(m) FROM w) AS w, predicted, r FROM x JOIN w USING (predicted)) SELECT observed AS class, round(sum(w * q) * (SELECT sum(m) FROM w), 4) AS area, round(sqrt(sum(w * w * q * (1 - q) / (r - 1))) * (SELECT sum(m) FROM w), 4) AS se, round(coalesce(sum(w * q) FILTER (predicted = observed) / sum(w * q), 0), 6) AS producers, round(coalesce(sum(q) FILTER (predicted = observed), 0), 6) AS users FROM s GROUP BY 1")
def adjusted_areas(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    areas = m.groupBy(F.col("predicted").alias("class")).agg((F.sum("n") * F.col("predicted")).cast("double").alias("mapped"))
    out = accuracy.adjusted_areas(m, areas)
    return out.select("class", _r("area", 4).alias("area"), _r("se", 4).alias("se"), _r("producers").alias("producers"), _r("users").alias("users"))


@query(f"WITH {E1}, {O1}, g AS (SELECT i, j, e.class + 10 * (j // 25) AS r, o.class + 10 * (j // 20) AS p FROM e JOIN o USING (i, j)), ps AS (SELECT p, count(*) AS pn, avg(i) AS pi, avg(j) AS pj FROM g GROUP BY 1), rs AS (SELECT r, count(*) AS rn, avg(i) AS ri, avg(j) AS rj FROM g GROUP BY 1), b AS (SELECT r, p, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT r, arg_max(p, n * 1000 - p) AS p, max(n) AS n, count(*) AS parts FROM b GROUP BY 1) SELECT r AS reference, m.p AS predicted, round(1 - n / rn, 6) AS over, round(1 - n / pn, 6) AS under, round((parts - 1) / (rn - 1), 6) AS fragments, round(sqrt(power(ri - pi, 2) + power(rj - pj, 2)), 6) AS offset_ FROM m JOIN rs USING (r) JOIN ps USING (p)")
def object_accuracy(spark, sf_dir):
    a = t.event_grid(spark, sf_dir).select("i", "j", (F.col("class") + 10 * F.floor(F.col("j") / 25)).alias("r"))
    b = t.order_grid(spark, sf_dir).select("i", "j", (F.col("class") + 10 * F.floor(F.col("j") / 20)).alias("p"))
    out = accuracy.objects(a.join(b, ["i", "j"]), "r", "p")
    return out.select("reference", "predicted", *(_r(c).alias(c) for c in ("over", "under", "fragments")), _r("offset").alias("offset_"))


_ECC = "CASE WHEN (var_pop(i) + var_pop(j)) / 2 + sqrt(power((var_pop(i) - var_pop(j)) / 2, 2) + power(covar_pop(i, j), 2)) > 1e-12 THEN sqrt(greatest(1 - ((var_pop(i) + var_pop(j)) / 2 - sqrt(power((var_pop(i) - var_pop(j)) / 2, 2) + power(covar_pop(i, j), 2))) / ((var_pop(i) + var_pop(j)) / 2 + sqrt(power((var_pop(i) - var_pop(j)) / 2, 2) + power(covar_pop(i, j), 2))), 0)) ELSE 0 END"


@query(f"WITH {E1}, {O1}, g AS (SELECT i, j, e.class + 10 * (j // 25) AS r, o.class + 10 * (j // 20) AS p FROM e JOIN o USING (i, j)), ps AS (SELECT p, count(*) AS pn, {_ECC} AS pe FROM g GROUP BY 1), rs AS (SELECT r, count(*) AS rn, {_ECC} AS re FROM g GROUP BY 1), b AS (SELECT r, p, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT r, arg_max(p, n * 1000 - p) AS p FROM b GROUP BY 1) SELECT r AS reference, rn AS cells, pn AS predicted_cells, round(abs(re - pe), 6) AS shape, round((pn - rn) * 100.0::DOUBLE / rn, 6) AS relative FROM m JOIN rs USING (r) JOIN ps USING (p)")
def object_shapes(spark, sf_dir):
    a = t.event_grid(spark, sf_dir).select("i", "j", (F.col("class") + 10 * F.floor(F.col("j") / 25)).alias("r"))
    b = t.order_grid(spark, sf_dir).select("i", "j", (F.col("class") + 10 * F.floor(F.col("j") / 20)).alias("p"))
    return accuracy.objects(a.join(b, ["i", "j"]), "r", "p").select("reference", "cells", "predicted_cells", _r("shape").alias("shape"), _r("relative").alias("relative"))


# sampling


@query(f"WITH {E1}, p AS (SELECT c_custkey, c_custkey * 7 % 100 + 0.5 AS x, 9.5 - c_custkey % 10 AS y FROM customer) SELECT c_custkey, i, j, value FROM (SELECT c_custkey, floor(10 - y)::BIGINT AS i, floor(x)::BIGINT AS j FROM p) JOIN e USING (i, j)")
def sample_points(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 100 + 0.5).alias("x"), (F.lit(9.5) - F.col("c_custkey") % 10).alias("y"))
    return sampling.sample_points(c, t.event_grid(spark, sf_dir), Extent(0, 10, 100, 0), ["value"]).select("c_custkey", "i", "j", "value")


@query(f"WITH {E1} SELECT (j + 0.5)::DOUBLE AS x, (10 - (i + 0.5))::DOUBLE AS y, class FROM e WHERE class <> 3 AND i % 3 = 0 AND j % 3 = 0")
def cells_to_points(spark, sf_dir):
    p = sampling.cell_points(t.event_grid(spark, sf_dir), Extent(0, 10, 100, 0), "class", 3, 3)
    return p.select("x", "y", "class")


_ORDER = "('0x' || md5('1:' || {0})[1:15])::BIGINT, {0}"


@query(f"SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_ORDER.format('c_custkey')}) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.3) THEN 'train' ELSE 'test' END AS part FROM customer")
def split_by_class(spark, sf_dir):
    return sampling.split(t.table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 0.3).select("c_custkey", "c_mktsegment", "part")


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_ORDER.format('o_orderkey')}) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS part FROM orders")
def split_all(spark, sf_dir):
    return sampling.split(t.table(spark, sf_dir, "orders"), "o_orderkey", share=0.7).select("o_orderkey", "part")


@query("WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, round(n / sum(n) OVER (), 6)::DOUBLE AS weight FROM c")
def class_weights(spark, sf_dir):
    return sampling.class_weights(t.table(spark, sf_dir, "customer"), "c_mktsegment").select("c_mktsegment", "n", _r("weight").alias("weight"))


@query("WITH p AS (SELECT c_custkey AS k, c_acctbal AS x, c_custkey % 97 * 10.0 AS y FROM customer), s AS (SELECT s_suppkey AS k, s_acctbal AS x, s_suppkey % 89 * 10.0 AS y FROM supplier), d AS (SELECT p.k AS c_custkey, s.k AS s_suppkey, sqrt((p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y)) AS d FROM p, s), m AS (SELECT c_custkey, min(d) AS d FROM d GROUP BY 1) SELECT c_custkey, round(d, 5) AS distance FROM m")
def nearest_neighbour(spark, sf_dir):
    p = t.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97 * 10.0).alias("y"))
    s = t.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 89 * 10.0).alias("y"))
    return sampling.nearest(p, s, "c_custkey", "s_suppkey", 2000.0).select("c_custkey", _r("distance", 5).alias("distance"))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.95) AS b FROM part) SELECT p_partkey, round((p_retailprice - m) / (b - a), 6) AS p_retailprice FROM part, q")
def robust_scaling(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return sampling.robust_scaled(p, ["p_retailprice"]).select("p_partkey", _r("p_retailprice").alias("p_retailprice"))


@query(f"WITH {M1}, x AS (SELECT label, unnest([{{'f': 'red', 'v': red}}, {{'f': 'nir', 'v': nir}}, {{'f': 'blue', 'v': blue}}]) AS s FROM b), o AS (SELECT s.f AS feature, label, sum(s.v) AS o, count(*) AS n FROM x GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM o) SELECT feature, round(sum((o - e) * (o - e) / e), 6) AS score FROM e GROUP BY 1")
def rank_features(spark, sf_dir):
    return sampling.chi_square(t.reflectances(spark, sf_dir), ["red", "nir", "blue"], "label").select("feature", _r("score").alias("score"))


# dates and calibration


@query("SELECT o_orderkey, (year(o_orderdate) * 1000 + dayofyear(o_orderdate))::INT AS code, (year(o_orderdate)::VARCHAR || '-' || lpad(dayofyear(o_orderdate)::VARCHAR, 3, '0')) AS text, (year(o_orderdate)::VARCHAR || lpad(month(o_orderdate)::VARCHAR, 3, '0')) AS months, dayofyear(make_date(year(o_orderdate), 12, 31))::INT AS days FROM orders")
def ordinal_dates(spark, sf_dir):
    code = dates.yyyyddd(F.col("o_orderdate"))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", code.cast("int").alias("code"), dates.ordinal_text(code).alias("text"), dates.months(code).alias("months"), dates.days_in_year(F.year("o_orderdate")).cast("int").alias("days"))


@query("SELECT o_orderkey, date_diff('day', first_value(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate::DATE)::INT + 1 AS day FROM orders")
def running_days(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("ord"), dates.yyyyddd(F.col("o_orderdate")).alias("code"))
    return dates.running_days(o, "code", "ord", "o_custkey", 1).select("o_orderkey", F.col("day").cast("int").alias("day"))


@query("WITH r AS (SELECT o_orderkey, dayofyear(o_orderdate) AS d, greatest(o_totalprice / 2000 * 0.775 - 6.2, 0) AS l, power(1 - 0.01672 * cos(radians(0.9856 * (dayofyear(o_orderdate) - 4))), 2) AS q FROM orders) SELECT o_orderkey, round(l, 6) AS radiance, round(pi() * l * q / (1536 * cos(radians(90 - 45.0))), 8) AS reflectance, round(CASE WHEN l > 0 THEN 1260.56 / ln(607.76 / l + 1) END, 5) AS kelvin FROM r")
def calibrate(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    lum = calibration.radiance(F.col("o_totalprice") / 2000, "landsat", 0.775, -6.2)
    ref = calibration.reflectance(lum, F.dayofyear("o_orderdate"), 1536.0, F.lit(45.0))
    return o.select("o_orderkey", _r(lum).alias("radiance"), _r(ref, 8).alias("reflectance"), _r(calibration.kelvin(lum, 607.76, 1260.56), 5).alias("kelvin"))


@query("SELECT o_orderkey, CASE WHEN (o_orderkey >> 6 & 3) >= 3 THEN 2 WHEN (o_orderkey >> 14 & 3) >= 3 THEN 4 WHEN (o_orderkey >> 4 & 3) >= 3 THEN 1 ELSE 0 END::INT AS code FROM orders")
def quality_mask(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select("o_orderkey", calibration.quality(F.col("o_orderkey"), "L8", ["water", "cloud", "shadow"]).alias("code"))


@query("WITH c AS (SELECT p_size AS dn, count(*) AS n FROM part GROUP BY 1) SELECT min(dn)::INT AS dark FROM c WHERE dn >= 1 AND n >= 10")
def dark_object(spark, sf_dir):
    where, agg = calibration.dark_number(F.col("p_size"), 10)
    return t.table(spark, sf_dir, "part").groupBy("p_size").count().where(where).agg(agg.cast("int").alias("dark"))


# vectors

_BOXES = "x AS (SELECT s_suppkey, (s_suppkey * 13 % 90)::DOUBLE AS l, (s_suppkey * 7 % 80)::DOUBLE AS b FROM supplier)"


def _polygons(spark, sf_dir):
    s = t.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 13 % 90 + 5.0).alias("x"), (F.col("s_suppkey") * 7 % 80 + 5.0).alias("y"))
    return s.select("s_suppkey", vector.square(F.col("x"), F.col("y"), 5.0).alias("ring"))


@query(f"WITH {_BOXES}, p AS (SELECT c_custkey, c_custkey * 37 % 1000 / 10.0 + 0.05 AS px, c_custkey * 91 % 1000 / 10.0 + 0.05 AS py FROM customer) SELECT c_custkey, s_suppkey FROM p JOIN x ON px > l AND px < l + 10 AND py > b AND py < b + 10")
def points_in_polygons(spark, sf_dir):
    p = t.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 1000 / 10.0 + 0.05).alias("x"), (F.col("c_custkey") * 91 % 1000 / 10.0 + 0.05).alias("y"))
    return vector.points_in(p, _polygons(spark, sf_dir), "s_suppkey", 10.0).select("c_custkey", "s_suppkey")


@query(f"WITH {_BOXES} SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM x a JOIN x b ON a.l < b.l + 10 AND b.l < a.l + 10 AND a.b < b.b + 10 AND b.b < a.b + 10")
def boxes_overlap(spark, sf_dir):
    p = _polygons(spark, sf_dir).select("s_suppkey", vector.bounds(F.col("ring")).alias("e")).select("s_suppkey", "e.*")
    return vector.boxes_overlap(p.withColumnRenamed("s_suppkey", "a"), p.withColumnRenamed("s_suppkey", "b"), "a", "b", 10.0)


@query(f"WITH {_BOXES}, c AS (SELECT u.i AS i, v.j AS j FROM range(100) AS u(i), range(100) AS v(j)) SELECT i, j, max(s_suppkey) AS s_suppkey FROM c JOIN x ON j + 0.5 > l AND j + 0.5 < l + 10 AND 100 - i - 0.5 > b AND 100 - i - 0.5 < b + 10 GROUP BY 1, 2")
def rasterize_polygons(spark, sf_dir):
    out = vector.rasterized(_polygons(spark, sf_dir), Extent(0, 100, 100, 0), "s_suppkey")
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "s_suppkey")


@query(f"WITH {_BOXES}, c AS (SELECT u.i AS i, v.j AS j FROM range(50) AS u(i), range(50) AS v(j)) SELECT i, j, max(s_suppkey) AS s_suppkey FROM c JOIN x ON 2 * j < l + 9.5 AND 2 * j + 2 > l + 0.5 AND 100 - 2 * i - 2 < b + 9.5 AND 100 - 2 * i > b + 0.5 GROUP BY 1, 2")
def rasterize_touched(spark, sf_dir):
    """All cells of two by two that squares of nine by nine cover a part of."""
    s = t.table(spark, sf_dir, "supplier").select("s_suppkey", vector.square(F.col("s_suppkey") * 13 % 90 + 5.0, F.col("s_suppkey") * 7 % 80 + 5.0, 4.5).alias("ring"))
    out = vector.rasterized(s, Extent(0, 100, 100, 0, 2, 2), "s_suppkey", all_touched=True)
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "s_suppkey")


@query(f"WITH {_BOXES} SELECT s_suppkey, 100.0::DOUBLE AS area, l + 5 AS x, b + 5 AS y FROM x")
def polygon_measures(spark, sf_dir):
    c = vector.centroid(F.col("ring"))
    return _polygons(spark, sf_dir).select("s_suppkey", _r(vector.area(F.col("ring"))).alias("area"), _r(c["x"]).alias("x"), _r(c["y"]).alias("y"))


@query()
def convex_hull(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return vector.hull(p, "p_brand").select("p_brand", F.size("ring").alias("corners"), _r(vector.area(F.col("ring")), 4).alias("area"))


@query("SELECT c_custkey, (CASE WHEN c_acctbal >= 0 THEN 32600 ELSE 32700 END + floor((c_custkey % 360) / 6) + 1)::INT AS zone FROM customer")
def utm_zones(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer")
    return c.select("c_custkey", vector.utm_zone((F.col("c_custkey") % 360 - 180).cast("double"), F.col("c_acctbal")).alias("zone"))
