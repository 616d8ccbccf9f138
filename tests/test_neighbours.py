"""Neighbours and labels against numpy."""

import numpy as np
import pytest

from gridlake.operators import neighbours, sampling


def table(spark, x, y=None):
    rows = [(k, -1 if y is None else int(y[k]), *map(float, v)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long, y int", *(f"f{k} double" for k in range(x.shape[1]))]))


def nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def spread(near, y, method, alpha=0.2, rounds=30, tolerance=1e-3):
    classes = np.unique(y[y != -1])
    first = (y[:, None] == classes).astype(float)
    now = first
    for _ in range(rounds):
        new = now[near].mean(1)
        new = np.where((y != -1)[:, None], first, new) if method == "propagate" else alpha * new + (1 - alpha) * first
        done = np.abs(new - now).max() <= tolerance
        now = new
        if done:
            break
    found = np.where(now.max(1) > 0, classes[np.round(now, 12).argmax(1)], -1)
    return np.where(y == -1, found, y)


def test_one_leaf_is_exact(spark):
    x = np.random.default_rng(1).random((200, 3))
    x[50:60] = x[40]
    got = {(r.a, r.place): r.b for r in neighbours.nearest_rows(table(spark, x), "id", ["f0", "f1", "f2"], 4).collect()}
    want = nearest(x, 4)
    assert got == {(a, p + 1): want[a, p] for a in range(200) for p in range(4)}


def test_recall_and_large_leaves(spark):
    """Of the true neighbours nine of ten are found in small leaves, and all in one large leaf cut into blocks."""
    x = np.random.default_rng(2).random((3000, 6))
    want = {(a, b) for a, row in enumerate(nearest(x, 5)) for b in row}
    names = [f"f{k}" for k in range(6)]
    found = lambda **how: {(r.a, r.b) for r in neighbours.nearest_rows(table(spark, x), "id", names, 5, **how).collect()}
    assert len(want & found()) >= 0.9 * len(want)
    assert found(leaf=4000, block=400) == want


@pytest.mark.parametrize("method", ["propagate", "spread"])
def test_labels_spread(spark, method):
    """Two half circles with few labels, and a far group that no label reaches."""
    rng = np.random.default_rng(3)
    t = rng.uniform(0, np.pi, 160)
    x = np.r_[np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.4 - np.sin(t)], rng.normal(50, 0.1, (20, 2))] + rng.normal(0, 0.03, (340, 2))
    y = np.full(340, -1)
    y[[0, 1, 2]], y[[160, 161, 162]] = 4, 7
    got = {r.id: r.y for r in neighbours.propagated(table(spark, x, y), "id", "y", ["f0", "f1"], 5, method, rounds=12, leaf=1000).collect()}
    want = spread(nearest(x, 5), y, method, rounds=12)
    assert [got[k] for k in range(340)] == want.tolist() and set(want[320:]) == {-1} and {4, 7} <= set(want[:320])


def test_cases(spark):
    df = spark.createDataFrame([(1, 3, 0.0), (2, -1, 0.1), (3, -1, None), (4, -1, float("nan"))], "id long, y int, a double")
    assert {(r.id, r.y) for r in neighbours.propagated(df, "id", "y", ["a"], 2).collect()} == {(1, 3), (2, 3), (3, -1), (4, -1)}
    assert neighbours.propagated(df.limit(0), "id", "y", ["a"]).count() == 0
    assert {r.y for r in neighbours.propagated(df.where("y = -1"), "id", "y", ["a"]).collect()} == {-1}


def test_nearest_of_many_targets_within_the_radius(spark):
    """A radius that holds all targets: points meet few of them, and the nearest of the least key among equals."""
    rng = np.random.default_rng(6)
    t, p = np.round(rng.uniform(0, 50, (3000, 2)), 1), rng.uniform(-20, 70, (400, 2))
    t[:300] = t[300:600]  # equal places
    t[600:900] = 10 + t[600:900] / 1000  # and many in a narrow one
    frame = lambda v: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(v)], "k long, x double, y double")
    targets = frame(t).withColumnRenamed("k", "t")
    d = np.sqrt(((p[:, None] - t[None]) ** 2).sum(2))
    got = {r.k: (r.t, r.distance) for r in sampling.nearest(frame(p), targets, "k", "t", 2000.0).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert np.allclose([got[k][1] for k in range(400)], d.min(1))
    assert sampling._near(frame(p), targets, "k", "t", 2000.0, "x", "y").count() < 400 * 300  # of 400 * 3000 pairs
