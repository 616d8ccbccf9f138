"""Kernels and parsers against plain computations."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions import calibration, dates, indices
from gridlake.functions.expressions import expression
from gridlake.model import Extent, tiles
from gridlake.operators import accuracy, focal, grid, learn, local_stats, series, thematic, vector
from gridlake.sources import catalog, metadata
from gridlake.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ** 3 ** 2", 512), ("-2 ** 2", -4), ("a / b", 2.5), ("a / 0", None), ("sqrt(-1)", None), ("where(a > 4, 10, 20) + 1", 11), ("(a > 4) & (b < 1)", 0), ("6 & 3", 2), ("6 | 1", 7), ("1 << 3", 8), ("~0", -1), ("minimum(a, b)", 2), ("nan_to_num(a / 0)", 0), ("7 % 4", 3), ("1e1 * .5", 5)],
)
def test_expression(spark, text, want):
    assert one(spark, expression(text, {"a": F.col("a"), "b": F.col("b")}), a=5.0, b=2.0) == want


@pytest.mark.parametrize("text", ["__import__('os')", "a +", "a b", "f(a)", "a.b", "where(a, 1)", "(a", "'x'"])
def test_expression_rejects(spark, text):
    with pytest.raises(ValueError):
        expression(text, {"a": F.lit(1), "b": F.lit(2)})


def test_extents():
    a, b = Extent(0, 10, 10, 0), Extent(2, 8, 6, 4)
    assert a.contains(b) and b.within(a) and not b.contains(a) and not a.contains(a)
    assert a.overlaps(b) and a.outside(Extent(10, 10, 12, 0)) and a.shape == (10, 10)
    assert a.intersects_strict(b) and not b.intersects_strict(a)
    assert a.intersection(Extent(5, 20, 15, 5)) == Extent(5, 10, 10, 5) and a.offsets(3.5, 7.2) == (2, 3)
    assert tiles(5, 5, 3) == [(0, 0, 3, 3), (0, 3, 3, 2), (3, 0, 2, 3), (3, 3, 2, 2)]
    assert tiles(5, 5, 3, 1)[3] == (2, 2, 3, 3)


def test_index_rules(spark):
    v = lambda r, n, **how: one(spark, indices.index("NDVI", F.col("r"), F.col("n"), **how), r=r, n=n)
    assert v(1.0, 3.0) == 0.5 and v(0.0, 3.0) == 0 and v(1.0, -1.0, no_data=-9.0) == -9
    assert v(1.0, 3.0, rescale=(0, 254)) == 190 and v(100.0, 300.0, scale=100.0) == 0.5
    assert indices.band_numbers("ndvi", "Landsat8") == [4, 5]
    with pytest.raises(ValueError):
        indices.band_numbers("YNDVI", "Landsat")
    assert "EVI" in indices.supported("Landsat") and "NDII" not in indices.supported("Landsat")


def test_dates(spark):
    assert one(spark, dates.ordinal_text(F.lit(2001366))) == "2002-001"
    assert one(spark, dates.steps(F.lit(2000360), F.lit(2001010), 10)) == [2000360, 2001004]
    assert one(spark, dates.day_of_year(F.lit(3), F.lit(1), F.lit(2000))) == 61
    assert one(spark, dates.sun_distance_squared(F.lit(4))) == pytest.approx((1 - 0.01672) ** 2)


def test_calibration(spark):
    assert calibration.gain_bias(-1.5, 193.0) == pytest.approx((194.5 / 254, -1.5 - 194.5 / 254))
    assert one(spark, calibration.radiance(F.lit(1), "aster", 0.6)) == 0
    assert one(spark, calibration.quality(F.lit(0b1100000000110000), "L8", ["water", "cloud"])) == 4
    assert one(spark, calibration.kelvin(F.lit(0.0), 1.0, 1.0)) is None
    assert one(spark, calibration.stored(F.lit(1.7), "byte")) == 255


def frame(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i long, j long, v double")


def array(df, shape, col="out"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.i, r.j] = r[col]
    return out


@pytest.mark.parametrize("name", focal.TILED)
def test_tiles_equal_the_whole(spark, name):
    a = np.random.default_rng(1).random((30, 23)).round(1)
    pad = 9 if name == "circles" else 3  # a stamp may begin further out
    whole = focal.kernel(name, np.pad(a, pad), 5)[pad:-pad, pad:-pad]
    got = array(focal.tiled(frame(spark, a), "v", name, 5, tile=8), a.shape)
    assert got == pytest.approx(whole)


@pytest.mark.parametrize("size, tile", [(5, 8), (7, 8), (7, 3)])
def test_circles_over_tiles_equal_the_whole(spark, size, tile):
    a = np.random.default_rng(1).random((30, 23)).round(1) * (np.random.default_rng(2).random((30, 23)) < 0.3)
    whole = focal.kernel("circles", np.pad(a, 9), size, least=0.4)[9:-9, 9:-9]
    got = array(focal.tiled(frame(spark, a), "v", "circles", size, tile=tile, least=0.4), a.shape)
    assert 0 < whole.mean() < 1 and (got == whole).all()


def test_relaxation_keeps_shape():
    p = np.random.default_rng(2).dirichlet([1, 1, 1], (6, 7)).transpose(2, 0, 1)
    out = focal.relaxed(p, np.eye(3), 3, 2)
    assert out.shape == p.shape and (out <= p + 1e-12).all()


def test_borders(spark):
    a = np.arange(20.0).reshape(4, 5)
    assert array(focal.moving_window(frame(spark, a), "v", "mean", 3), a.shape)[1, 1] == 6
    assert array(focal.moving_window(frame(spark, a), "v", "mean", 3), a.shape)[0].tolist() == [0] * 5
    assert np.isnan(array(focal.moving_window(frame(spark, a), "v", "max", 3, border="null"), a.shape)[0].astype(float)).all()
    with pytest.raises(ValueError):
        focal.moving_window(frame(spark, a), "v", "mean", 4)


def test_local_statistics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, float("nan"), 0.0],), ([],), ([0.0, 0.0],)], "b array<double>")
    got = [r.x for r in local_stats.pixel_stat(df, "b", "mean", "x", ignore=0.0, no_data=-1.0).collect()]
    assert got == [pytest.approx(5 / 3), -1, -1]
    assert local_stats.pixel_stat(df, "b", "mode", "x").first().x == 2
    assert local_stats.pixel_stat(df, "b", "max", "x", above=1.0, no_data=-1.0).first().x == -1


def test_interpolation(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([0.0, 2.0, 0.0, 6.0, 0.0, 0.0])] + [(2, 0, 0.0)], "k int, t int, v double")
    got = [r.v_filled for r in series.interpolate(df, "v", ["k"], "t").orderBy("k", "t").collect()]
    assert got == [2, 2, 4, 6, 6, 6, 0]


def test_recode_is_sequential(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (1, 1)], "c int, z int")
    assert [r.c for r in thematic.recode(df, "c", "z", {0: [(1, 2), (2, 3)]}).collect()] == [3, 3, 1]
    assert [r.x for r in df.select(thematic.reclassify(F.col("c"), {1: 2, 2: 1}).alias("x")).collect()] == [2, 1, 2]


def test_kappa_and_pairs(spark):
    m = spark.createDataFrame([(1, 1, 5), (1, 2, 1), (2, 2, 4)], "predicted int, observed int, n long")
    assert accuracy.pairs(m).count() == 10
    assert accuracy.kappa(m).first().kappa == pytest.approx(accuracy.summary(m).first().kappa)
    assert accuracy.kappa(m, off_by_one=True).first().kappa is None


def test_hull_and_utm(spark):
    rng = np.random.default_rng(3)
    pts = [(1, float(x), float(y)) for x, y in rng.random((200, 2))] + [(1, a, b) for a in (0.0, 1.0) for b in (0.0, 1.0)] + [(2, 0.5, 0.5)]
    got = {r.g: r.ring for r in vector.hull(spark.createDataFrame(pts, "g int, x double, y double"), "g").collect()}
    assert sorted((p.x, p.y) for p in got[1]) == [(0, 0), (0, 1), (1, 0), (1, 1)] and len(got[2]) == 1
    e, n = vector.to_utm(F.lit(9.0), F.lit(0.0), F.lit(32632))
    assert one(spark, e) == pytest.approx(500000) and one(spark, n) == pytest.approx(0, abs=1e-6)
    e, n = vector.to_utm(F.lit(11.0), F.lit(48.0), F.lit(32632))
    assert one(spark, e) == pytest.approx(649187.9, abs=0.5) and 5318200 < one(spark, n) < 5318500


def test_metadata_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('GROUP = X\n  SUN = 45.5\n  ID = "LC8"\nEND_GROUP = X\nEND\n')
    got = metadata.read_key_values(spark, str(tmp_path / "a.txt")).first()["values"]
    assert got == {"SUN": "45.5", "ID": "LC8"}
    (tmp_path / "a.raw").write_bytes(struct.pack("<12h", *range(12)))
    cells = {(r.i, r.j): list(r.bands) for r in metadata.read_raw(spark, str(tmp_path / "a.raw"), 2, 3, 2, 2, "bsq").collect()}
    assert cells[1, 2] == [5.0, 11.0] and len(cells) == 6


def test_catalogue_on_disk(spark, tmp_path):
    t = spark.createDataFrame([(33, "N", "g1", "oli", 0, 0, 1.0), (33, "N", "g2", "oli", 0, 0, 2.0)], "utm int, latitude string, grid string, sensor string, i int, j int, v double")
    catalog.save(t, str(tmp_path / "c"))
    catalog.save(t.where("grid = 'g2'").withColumn("v", F.lit(5.0)), str(tmp_path / "c"))
    assert {(r.grid, r.v) for r in catalog.load(spark, str(tmp_path / "c")).collect()} == {("g1", 1.0), ("g2", 5.0)}


def test_stream_fills_a_table(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "i long, j long, v double").coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest.fill_table(ingest.cells(spark, src, "i long, j long, v double"), out, "v", str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(0, 0, 9.0), (0, 1, 7.0), (1, 1, 3.0)], "i long, j long, v double").coalesce(1).write.mode("append").parquet(src)
    ingest.fill_table(ingest.cells(spark, src, "i long, j long, v double"), out, "v", str(tmp_path / "ck")).awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert {(r.i, r.j): r.v for r in spark.read.parquet(f"{out}/v={last}").collect()} == {(0, 0): 1, (0, 1): 7, (1, 1): 3}


def test_models(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(i % 2), float(rng.normal() + 4 * (i % 2)), float(rng.normal())) for i in range(120)], "id long, y double, a double, b double")
    assert min(learn.cross_validation(df, "id", "y", ["a", "b"], "dt", 2)) > 0.85
    best, table = learn.grid_search(df, "id", "y", ["a", "b"], "dt", {"depth": [1, 3]}, 1)
    assert best["depth"] in (1, 3) and table.count() == 2
    with pytest.raises(ValueError):
        learn.estimator("gridcrf", "y", ["a"])
    half = df.withColumn("y", F.when(F.col("id") < 20, F.col("y")).otherwise(-1.0))
    got = {r.id: r.y for r in learn.propagated(half, "id", "y", ["a"]).collect()}
    assert np.mean([got[i] == i % 2 for i in range(120)]) > 0.85
    assert math.isclose(len(learn.without_outliers(df, "id", "y", ["a", "b"], 0.1).collect()), 108)


def test_mosaic_and_resample(spark):
    a, b = (spark.createDataFrame(r, "i long, j long, v double") for r in ([(0, 0, 1.0), (0, 1, 2.0)], [(0, 1, 0.0), (0, 2, 3.0)]))
    assert {(r.i, r.j): r.v for r in grid.mosaic([a, b], "v").collect()} == {(0, 0): 1, (0, 1): 2, (0, 2): 3}
    big = grid.resample(a, Extent(0, 1, 2, 0), Extent(0, 1, 2, 0, 0.5, 0.5), "v")
    assert big.count() == 8


def test_nearest_at_any_distance(spark):
    """Targets a million cells away, close ties, points and targets without coordinates, none at all."""
    import math
    import random

    from gridlake.operators import sampling

    rnd = random.Random(1)
    targets = [(k, rnd.uniform(0, 50), rnd.uniform(0, 50)) for k in range(60)] + [(60, 1e6, 0.0), (61, 1e6, 1e6), (62, 1e6, 1e6), (63, None, 1.0), (64, -9e5, -9e5)]
    points = [(k, rnd.uniform(-2e6, 2e6), rnd.uniform(-2e6, 2e6)) for k in range(80)] + [(k, rnd.uniform(-5, 55), rnd.uniform(-5, 55)) for k in range(80, 160)] + [(160, None, 2.0), (161, 1e6, 1e6)]
    p, t = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(targets, "t long, x double, y double")
    want = {}
    for k, x, y in points:
        if x is not None:
            d, n = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in targets if a is not None)
            want[k] = (n, pytest.approx(d))
    assert {r.p: (r.t, r.distance) for r in sampling.nearest(p, t, "p", "t", 1.0).collect()} == want
    assert sampling.nearest(p, t.limit(0), "p", "t", 1.0).count() == 0
    one = sampling.distance_weights(sampling.nearest(p, t.where("t = 60"), "p", "t", 3.0)).collect()
    assert len(one) == 161 and min(r.weight for r in one) == 0


def test_split_takes_exact_numbers(spark):
    """Of each label, null included, and of all rows; ranges don't depend on partitions."""
    from gridlake.operators import sampling

    df = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, id % 3) AS label", "id AS part")
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    got = sampling.split(df, "id", "label", 0.3)
    assert got.columns == ["id", "label", "part"] and got.count() == 5000
    assert {r.label: r["count"] for r in got.where("part = 'train'").groupBy("label").count().collect()} == {k: int(n * 0.3) for k, n in sizes.items()}
    assert sampling.split(df, "id", share=0.25).where("part = 'train'").count() == 1250
    assert {r.label: r["count"] for r in sampling.split(df, "id", "label", count={0: 10, 1: 10**6}).where("part = 'train'").groupBy("label").count().collect()} == {0: 10, 1: sizes[1]}
    assert set(sampling.split(df.repartition(9), "id", "label", 0.3).collect()) == set(got.collect())


@pytest.mark.parametrize("tile", [5, 64])
def test_relaxation_over_tiles(spark, tile):
    import numpy as np

    from gridlake.operators import focal

    rng = np.random.default_rng(1)
    p, m = rng.random((3, 12, 14)), rng.random((3, 3))
    df = spark.createDataFrame([(i, j, *map(float, p[:, i, j])) for i in range(12) for j in range(14)], "i long, j long, a double, b double, c double")
    out = np.zeros_like(p)
    for r in focal.relaxed_grid(df, ["a", "b", "c"], m, 5, 3, tile).collect():
        out[:, r.i, r.j] = r.a, r.b, r.c
    assert np.allclose(out, focal.relaxed(p, m, 5, 3))


def test_series_of_any_length(spark):
    """Series of several lengths, too short ones, empty and null ones, with nulls; other columns stay."""
    rows = [(1, [1.0, 2.0, 4.0, 8.0]), (2, [3.0]), (3, []), (4, None), (5, [1.0, None, 3.0]), (6, [float(k * k) for k in range(20)]), (7, [1.0, -1.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").withColumn("mean", F.lit("old"))
    got = {r.id: r for r in local_stats.series_features(df, "x").collect()}
    assert len(got) == 8 and got[1].x == rows[0][1]
    assert (got[1].mean, got[1].fifty, got[1].five_cumulative, got[1].ninety_five_cumulative, got[1].max_diff, got[1].min_slope) == (3.75, 3.0, 3.0, 15.0, 2.0, None)
    assert got[1].cv == pytest.approx(np.std(rows[0][1]) / 3.75) and got[7].cv == 0 and got[2].five == 3.0
    assert got[6].min_slope == pytest.approx(np.polyfit(range(15), [k * k for k in range(15)], 1)[0]) and got[6].max_slope == pytest.approx(24.0)
    assert all(got[k].mean is None and got[k].fifty is None and got[k].cv == 0 for k in (3, 4)) and all(got[k].mean is None and got[k].seventy_five is None for k in (5, 8))
