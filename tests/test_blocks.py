"""Functions, regions, outlines and distances over blocks against plain loops on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import blocks, graph, proximity, regions


def table(spark, a, holes=()):
    """An array as pixels, without the cells of ``holes``."""
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if (i, j) not in holes], "i long, j long, v double")


def array(df, shape, column):
    out = np.full(shape, np.nan)
    rows = df.collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows)
    for r in rows:
        out[r.i, r.j] = np.nan if r[column] is None else r[column]
    return out


@pytest.mark.parametrize("tile", [5, 64])
def test_two_layers_with_a_halo(spark, tile):
    """At every seam as on the whole arrays, whatever the tile; other values stand in for cells outside."""
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 17, 23))

    def function(x, at):
        far = sum(np.roll(x["b"], (i, j), (0, 1)) for i in (-2, 0, 2) for j in (-2, 0, 2))
        return [np.maximum(x["a"], far), np.add.outer(np.arange(len(far)) + at[0], np.arange(len(far)) + at[1])]

    got = blocks.block_function({"a": (table(spark, a), "v"), "b": (table(spark, b), "v")}, function, ["x", "place"], tile, 2, 0.0)
    wide = np.pad(b, 2)
    far = sum(wide[2 + i : 19 + i, 2 + j : 25 + j] for i in (-2, 0, 2) for j in (-2, 0, 2))
    assert np.allclose(array(got, a.shape, "x"), np.maximum(a, far)) and (array(got, a.shape, "place") == np.add.outer(np.arange(17), np.arange(23))).all()
    parts = lambda x, at, own: {"sum": x["a"][own].sum(), "least": x["a"][own].min(), "most": x["b"][own].max(), "n": own.sum(), "nothing": np.nan}
    how = {"sum": "sum", "least": "min", "most": "max", "n": "sum", "nothing": "sum"}
    made = {r.name: r.value for r in blocks.block_totals({"a": (table(spark, a), "v"), "b": (table(spark, b), "v")}, parts, how, tile, 1).collect()}
    assert made == pytest.approx({"sum": a.sum(), "least": a.min(), "most": b.max(), "n": a.size})


def test_block_cases(spark):
    """Layers of other cells, nulls, repeated rows, cells left of and above the first, none."""
    a = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (0, 1, None), (-3, -1, 2.0), (None, 1, 3.0)], "i long, j long, v double")
    b = spark.createDataFrame([(7, 7, 5)], "i long, j long, w int")
    got = blocks.block_function({"a": (a, "v"), "b": (b, "w")}, lambda x, at: np.nansum([x["a"], x["b"]], axis=0), ["s"], 4)
    assert {(r.i, r.j): r.s for r in got.collect()} == {(0, 0): 1.0, (0, 1): 0.0, (-3, -1): 2.0, (7, 7): 5.0} and got.count() == 4
    assert blocks.block_function({"a": (a.limit(0), "v")}, lambda x, at: x["a"], ["s"]).count() == 0
    assert blocks.block_totals({"a": (a.limit(0), "v")}, lambda x, at, own: {"n": 1}, {"n": "sum"}).count() == 0


def flood(a, holes=()):
    """Region numbers by flooding in reading order."""
    out = np.full(a.shape, np.nan)
    for i, j in np.ndindex(a.shape):
        if np.isnan(out[i, j]) and (i, j) not in holes:
            todo, out[i, j] = [(i, j)], regions.cell_number(i, j)
            while todo:
                x, y = todo.pop()
                for p, q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] and np.isnan(out[p, q]) and (p, q) not in holes and a[p, q] == a[x, y]:
                        out[p, q] = out[i, j]
                        todo.append((p, q))
    return out


def spiral(n):
    """A path one cell wide that winds to the middle."""
    a, i, j, di, dj = np.zeros((n, n)), 0, 0, 0, 1
    free = lambda p, q: 0 <= p < n and 0 <= q < n and not a[p, q]
    for _ in range(n * n):
        a[i, j] = 1
        p, q = i + 2 * di, j + 2 * dj
        if not free(i + di, j + dj) or (0 <= p < n and 0 <= q < n and a[p, q]):
            di, dj = dj, -di
            if not free(i + di, j + dj) or (0 <= i + 2 * di < n and 0 <= j + 2 * dj < n and a[i + 2 * di, j + 2 * dj]):
                break
        i, j = i + di, j + dj
    return a


@pytest.mark.parametrize("a, tile", [(np.random.default_rng(3).integers(0, 2, (14, 19)), 4), (np.random.default_rng(4).integers(0, 3, (12, 12)), 64), (spiral(17), 5)], ids=["random", "one tile", "spiral"])
def test_regions_and_outlines(spark, a, tile):
    holes = {(2, 3), (0, 0), (11, 11)}
    got = graph.written(regions.regions(table(spark, a, holes), "v", tile))
    want = flood(a, holes)
    assert np.array_equal(array(got, a.shape, "region"), want, equal_nan=True)
    rings = graph.written(regions.outlines(got, tile=tile))
    areas = regions.ring_areas(rings).collect()
    cells = {r: (want == r).sum() for r in np.unique(want[~np.isnan(want)])}
    assert {r: sum(x.area for x in areas if x.region == r) for r in cells} == cells
    assert all(sum(x.region == r and x.area > 0 for x in areas) == 1 for r in cells)  # one outer ring, others are holes
    by = {}
    for r in rings.collect():
        by.setdefault(r.ring, []).append((r.position, r.row, r.column))
    for corners in by.values():
        corners.sort()
        assert [c[0] for c in corners] == list(range(len(corners)))
        at = np.array([c[1:] for c in corners])
        assert (np.abs(np.roll(at, -1, 0) - at).sum(1) == 1).all()  # each corner is one side from the next
    assert sum(map(len, by.values())) == sum(want[i, j] != (want[p, q] if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] else -1) for i, j in np.ndindex(a.shape) if not np.isnan(want[i, j]) for p, q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)))


def test_outlines_send_arcs_not_edges(spark, monkeypatch):
    """Rings within a tile take no part in rounds of joins, of others the passages of seams; areas come in short runs."""
    sent = []
    plain = graph.components
    monkeypatch.setattr(graph, "components", lambda edges, *names: sent.append(edges.count()) or plain(edges, *names))
    a = np.random.default_rng(5).integers(0, 3, (40, 40))
    labelled = graph.written(regions.regions(table(spark, a), "v", 16))
    sent.clear()
    rings = graph.written(regions.outlines(labelled, tile=16))
    seams = sum((a[k - 1 : k + 1] == a[k - 1 : k]).sum() for k in (16, 32)) + sum((a[:, k - 1 : k + 1] == a[:, k - 1 : k]).sum() for k in (16, 32))
    assert len(sent) == 1 and 0 < sent[0] <= 4 * seams and sent[0] < rings.count() / 5
    one = graph.written(regions.outlines(labelled, tile=64))
    assert sent[1] == 0 and sorted(one.collect()) == sorted(rings.collect())
    whole = sorted(regions.ring_areas(rings).collect())
    monkeypatch.setattr(regions, "RUN", 3)
    assert sorted(regions.ring_areas(rings).collect()) == whole


def test_no_regions(spark):
    none = table(spark, np.zeros((0, 0)))
    assert regions.regions(none, "v").count() == 0 and regions.outlines(regions.regions(none, "v")).count() == 0
    assert proximity.distance_to(none, F.col("v") > 0).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_distances(spark, share):
    rng = np.random.default_rng(7)
    a = (rng.random((37, 29)) < share).astype(float)
    holes = {(5, 5), (5, 6), (36, 28)}
    hits = [(i, j) for i, j in np.argwhere(a) if (i, j) not in holes]
    want = np.full(a.shape, np.nan)
    for i, j in np.ndindex(a.shape):
        if (i, j) not in holes and hits:
            want[i, j] = min(np.hypot(i - p, j - q) for p, q in hits)
    cells = table(spark, a, holes).select((F.col("i") - 4).alias("i"), (F.col("j") + 9).alias("j"), "v")
    back = lambda df: df.select((F.col("i") + 4).alias("i"), (F.col("j") - 9).alias("j"), "distance")
    assert np.allclose(array(back(proximity.distance_to(cells, F.col("v") > 0)), a.shape, "distance"), want, equal_nan=True)
    near = array(back(proximity.distance_to(cells, F.col("v") > 0, 3)), a.shape, "distance")
    assert np.allclose(near, np.where(want <= 3, want, np.nan), equal_nan=True)


def test_lower_envelope():
    rng = np.random.default_rng(2)
    g = np.where(rng.random((9, 40)) < 0.5, np.inf, rng.integers(0, 900, (9, 40)).astype(float))
    g[3], g[4] = np.inf, 0
    j = np.arange(40)
    assert (proximity.lower_envelope(g) == ((j[:, None] - j) ** 2 + g[:, None, :]).min(2)).all()


def test_distances_between_bands(spark):
    """Cell by cell, with no data in some bands."""
    from gridlake.operators import focal

    rng = np.random.default_rng(9)
    a = np.where(rng.random((3, 9, 8)) < 0.1, -1.0, rng.random((3, 9, 8)))
    v = rng.uniform(-0.2, 1, (9, 8))
    df = spark.createDataFrame([(i, j, *map(float, a[:, i, j]), float(v[i, j])) for i, j in np.ndindex(v.shape)], "i long, j long, r double, g double, b double, v double")
    got = array(focal.moving_window(df, ["r", "g", "b", "v"], "distance", ignore=-1.0, tile=4), v.shape, "out")
    colour = array(focal.moving_window(df, ["r", "g", "b"], "rgb-distance", 5, tile=4), v.shape, "out")
    for i, j in np.ndindex(v.shape):
        near = [(p, q) for p in (-1, 0, 1) for q in (-1, 0, 1) if p or q]
        want = 0.0
        if 0 < i < 8 and 0 < j < 7:
            w = {(p, q): 0.7071 if p and q else 1.0 for p, q in near}
            far = sum(w[p, q] * np.sqrt(sum((x[i + p, j + q] - x[i, j]) ** 2 for x in a if x[i, j] != -1 and x[i + p, j + q] != -1)) for p, q in near)
            differ = sum(w[p, q] * abs(v[i, j] - v[i + p, j + q]) for p, q in near if v[i + p, j + q] > 0)
            want = a[:, i, j].mean() * v[i, j] * far * differ / sum(w.values()) ** 2
        assert got[i, j] == pytest.approx(want)
        wide = [(p, q) for p in range(-2, 3) for q in range(-2, 3)]
        assert colour[i, j] == pytest.approx(sum(np.linalg.norm(a[:, i + p, j + q] - a[:, i, j]) for p, q in wide) / 3 if 2 <= i < 7 and 2 <= j < 6 else 0)
    assert np.isnan(array(focal.colour_distance(df, ["r", "g", "b"], 3), v.shape, "out")).all()


def test_objects_of_masks(spark):
    """Each region of one mask against what covers most of it in the other, object by object."""
    from gridlake.operators import accuracy

    rng = np.random.default_rng(11)
    a, b = rng.random((2, 16, 18)) < 0.55
    cells = spark.createDataFrame([(i, j, int(a[i, j]), int(b[i, j]) if b[i, j] or i % 2 else None) for i, j in np.ndindex(a.shape)], "i long, j long, r int, p int")
    got = {r.reference: r for r in accuracy.objects_of_masks(cells, "r", "p", tile=5).collect()}
    labels = [np.where(m, flood(np.where(m, 1, 0), {c for c in np.ndindex(m.shape) if not m[c]}) + 1, 0) for m in (a, b)]

    def shape(m):
        at = np.argwhere(m)
        low, high = np.linalg.eigvalsh(np.cov(at.T, bias=True).reshape(2, 2)) if len(at) > 1 else (0, 0)
        return np.sqrt(max(1 - low / high, 0)) if high > 1e-12 else 0.0

    seen = 0
    for r in np.unique(labels[0][labels[0] > 0]):
        own = labels[0] == r
        over, n = np.unique(labels[1][own & (labels[1] > 0)], return_counts=True)
        if len(over):
            other = labels[1] == over[n.argmax()]
            x = got[int(r)]
            assert (x.predicted, x.cells, x.predicted_cells) == (over[n.argmax()], own.sum(), other.sum())
            assert (x.over, x.under, x.relative) == pytest.approx((1 - n.max() / own.sum(), 1 - n.max() / other.sum(), 100 * (other.sum() - own.sum()) / own.sum()))
            assert x.shape == pytest.approx(abs(shape(own) - shape(other)), abs=1e-6)
            assert x.offset == pytest.approx(np.linalg.norm(np.argwhere(own).mean(0) - np.argwhere(other).mean(0)))
            assert x.fragments == pytest.approx((len(over) - 1) / (own.sum() - 1) if own.sum() > 1 else 0)
            seen += 1
    assert seen == len(got) > 5


def test_warp_sends_source_cells_not_taps(spark, monkeypatch):
    """Over small tiles as over one; the plan has no join of sixteen taps for each target cell."""
    from gridlake.model import Extent
    from gridlake.operators import grid

    a = np.random.default_rng(2).normal(size=(9, 11))
    source, target = Extent(0.0, 9.0, 11.0, 0.0), Extent(-0.6, 9.4, 11.4, -0.2, 0.6, 0.8)
    made = lambda: grid.warp(table(spark, a, {(4, 4)}), source, target, "v", "cubic")
    whole = {(r.i, r.j): r.v for r in made().collect()}
    monkeypatch.setattr(grid, "TILE", 3)
    cut = made()
    assert {(r.i, r.j): r.v for r in cut.collect()} == pytest.approx(whole) and len(whole) > 150
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()
