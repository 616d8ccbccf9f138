"""Rasters written and read by Spark tasks."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlake.operators import grid
from gridlake.sources import raster


def table(spark, a):
    """A (band, row, column) array as pixels."""
    rows = [(i, j, *map(float, a[:, i, j])) for i in range(a.shape[1]) for j in range(a.shape[2])]
    return spark.createDataFrame(rows, ", ".join(["i long", "j long", *(f"x{k} double" for k in range(len(a)))]))


def array(df, shape, fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[:, r.i, r.j] = r[2:]
    return out


@pytest.mark.parametrize("interleave, kind", [("bsq", 5), ("bil", 2), ("bip", 4)])
def test_round_trip_in_blocks(spark, tmp_path, interleave, kind):
    a = np.random.default_rng(1).integers(-500, 500, (3, 23, 31)).astype(float)
    path = str(tmp_path / "r")
    of = raster.write_raster(table(spark, a), path, ["x0", "x1", "x2"], block=8, kind=kind, interleave=interleave, left=100.0, top=50.0, width=2.0, height=2.0)
    assert raster.layout(path) == of and of.extent.shape == (23, 31)
    assert sorted(os.listdir(path)) == sorted(["raster.hdr", *(f"block-{i}-{j}.dat" for i in range(3) for j in range(4))])
    assert (array(raster.open_raster(spark, path), a.shape) == a).all()
    part = grid.window(raster.open_raster(spark, path, [3, 1]), 7, 5, 4, 9)
    assert part.columns == ["i", "j", "b3", "b1"] and part.rdd.getNumPartitions() == 4
    want = np.full((2, 23, 31), np.nan)
    want[:, 7:11, 5:14] = a[[2, 0], 7:11, 5:14]
    assert np.array_equal(array(part, want.shape), want, equal_nan=True)


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_single_file(spark, tmp_path, interleave):
    """A raw file beside its header, in strips."""
    a = np.random.default_rng(2).integers(0, 90, (2, 9, 6)).astype(">i2")
    of = raster.Layout(9, 6, 2, 2, interleave, offset=5, big_endian=True)
    (tmp_path / "a.hdr").write_text(of.text())
    (tmp_path / "a.dat").write_bytes(b"12345" + a.transpose({"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]).tobytes())
    df = raster.open_raster(spark, str(tmp_path / "a.dat"), strip=100)
    assert df.rdd.getNumPartitions() == 3 and (array(df, a.shape) == a).all()
    got = df.where("i = 4 and j > 1 and j < 4 and b1 >= 0 and (i = 4 or j = 0)")
    assert got.rdd.getNumPartitions() == 1 and {(r.i, r.j, r.b1, r.b2) for r in got.collect()} == {(4, j, a[0, 4, j], a[1, 4, j]) for j in (2, 3)}
    assert df.where("i > 20").count() == 0
    (tmp_path / "a.dat").write_bytes(b"12345")
    with pytest.raises(PySparkException, match="shorter"):
        df.collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    a = np.ones((1, 20, 20))
    path = str(tmp_path / "r")
    bad = table(spark, a).withColumn("x0", F.when(F.col("i") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("x0")).cast("double"))
    with pytest.raises(PySparkException):
        raster.write_raster(bad, path, ["x0"], rows=20, columns=20, block=8)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(FileNotFoundError):
        raster.layout(path)
    raster.write_raster(table(spark, a), path, ["x0"], block=8)
    with pytest.raises(PySparkException):
        raster.write_raster(bad.withColumn("x0", F.col("x0") + 5), path, ["x0"], rows=20, columns=20, block=8)
    assert (array(raster.open_raster(spark, path), a.shape) == 1).all()  # the old one is whole


def test_cases(spark, tmp_path):
    """No cells, missing cells, nulls, cells outside, one cell twice, blocks replaced, fewer blocks written over more."""
    path = str(tmp_path / "r")
    cells = "i long, j long, v double"
    assert raster.write_raster(spark.createDataFrame([], cells), path, ["v"]).rows == 0
    assert raster.open_raster(spark, path).count() == 0
    rows = [(0, 0, 1.0), (0, 5, None), (9, 9, 2.0), (3, 3, 4.0), (3, 3, 4.0), (-1, 0, 5.0), (10, 0, 6.0), (None, 1, 7.0)]
    of = raster.write_raster(spark.createDataFrame(rows, cells), path, ["v"], rows=10, columns=10, block=4)
    seen = lambda: {(r.i, r.j): r.b1 for r in raster.open_raster(spark, path).collect()}
    assert seen() == {(0, 0): 1.0, (9, 9): 2.0, (3, 3): 4.0}
    raster.write_raster(spark.createDataFrame([(0, 1, 8.0)], cells), path, ["v"], like=of, mode="append")
    assert seen() == {(0, 1): 8.0, (9, 9): 2.0}
    with pytest.raises(PySparkException, match="another layout"):
        raster.write_raster(spark.createDataFrame([(0, 1, 8.0)], cells), path, ["v"], rows=4, columns=4, mode="append")
    raster.create_raster(spark, path, 3, 2, [5, 6], kind=1, no_data=None)
    assert (array(raster.open_raster(spark, path), (2, 3, 2)) == np.array([5, 6])[:, None, None]).all()
    with pytest.raises(PySparkException, match="no band 3"):
        raster.open_raster(spark, path, [3]).collect()
    with pytest.raises(ValueError, match="lines"):
        raster.parsed("ENVI\nsamples = 3\n")


def test_bad_parts_are_found(spark, tmp_path):
    """A short file, one with a value that is not finite, one that is missing, and good ones, band by band."""
    path = tmp_path / "r"
    a = np.random.default_rng(3).random((2, 16, 16))
    raster.write_raster(table(spark, a), str(path), ["x0", "x1"], block=8)
    seen = lambda: {r.band: (r.parts, r.bad, r.reasons) for r in raster.check_bands(spark, str(path)).collect()}
    assert seen() == {1: (4, 0, []), 2: (4, 0, [])}
    short = path / "block-0-0.dat"
    short.write_bytes(short.read_bytes()[: 8 * 8 * 8 + 9])  # the second band is cut
    odd = np.frombuffer((path / "block-1-1.dat").read_bytes()).copy()
    odd[3] = np.inf
    (path / "block-1-1.dat").write_bytes(odd.tobytes())
    (path / "block-0-1.dat").unlink()
    assert seen() == {1: (4, 1, ["not finite"]), 2: (4, 1, ["too short"])}
    held = grid.contains_value(raster.open_raster(spark, str(path), [1]).where("i >= 8 and j < 8"), ["b1"], a[0, 9, 3]).first()
    assert held.found and held.cells == 1
