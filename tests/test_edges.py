"""Edge linking by tiles, and by loops that know nothing of the kernels."""

import numpy as np
import pytest

from gridlake.operators import edges, focal


def table(spark, **layers):
    shape = next(iter(layers.values())).shape
    rows = [(i, j, *(float(a[i, j]) for a in layers.values())) for i, j in np.ndindex(shape)]
    return spark.createDataFrame(rows, ", ".join(["i long", "j long", *(f"{n} double" for n in layers)]))


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.out
    return out


def around(shape, i, j):
    return [(p, q) for p in range(max(0, i - 1), min(shape[0], i + 2)) for q in range(max(0, j - 1), min(shape[1], j + 2)) if (p, q) != (i, j)]


def cheapest(g, start, end):
    """Least cost by relaxing every cell until nothing changes."""
    box = [(i, j) for i in range(min(start[0], end[0]) - 2, max(start[0], end[0]) + 3) for j in range(min(start[1], end[1]) - 2, max(start[1], end[1]) + 3) if 0 <= i < g.shape[0] and 0 <= j < g.shape[1]]
    cost = dict.fromkeys(box, np.inf) | {start: 0.0}
    while True:
        new = {c: min([cost[c], *(cost[n] + np.hypot(n[0] - c[0], n[1] - c[1]) / (1 + g[c]) for n in around(g.shape, *c) if n in cost)]) for c in box}
        if new == cost:
            return cost[end]
        cost = new


def broken_lines(rng, n):
    """Lines with gaps on a noisy gradient that is strong along them."""
    edge, g = np.zeros((n, n), bool), rng.uniform(0, 20, (n, n))
    for _ in range(9):
        i, j = rng.integers(2, n - 2, 2)
        di, dj = [(0, 1), (1, 0), (1, 1), (1, -1)][rng.integers(4)]
        gap = rng.integers(3, 9)
        for k in range(15):
            if 0 <= i < n and 0 <= j < n:
                g[i, j] = rng.uniform(60, 200)
                edge[i, j] |= not gap <= k < gap + rng.integers(2, 5)
            i, j = i + di, j + dj
    return edge, g


def test_paths_are_cheapest():
    rng = np.random.default_rng(2)
    g = rng.uniform(0, 50, (20, 20))
    for _ in range(15):
        a, b = (tuple(map(int, rng.integers(0, 20, 2))) for _ in range(2))
        cost, way = edges.least_path(g, a, b)
        assert cost == pytest.approx(cheapest(g, a, b)) and way[0] == a and way[-1] == b
        assert sum(np.hypot(p[0] - q[0], p[1] - q[1]) / (1 + g[q]) for p, q in zip(way, way[1:])) == pytest.approx(cost)
    g[:, 10] = np.nan
    assert edges.least_path(g, (5, 8), (5, 12)) == (np.inf, [])


def test_endpoints():
    edge = np.random.default_rng(1).random((30, 30)) < 0.2
    want = [[edge[i, j] and sum(edge[c] for c in around(edge.shape, i, j)) == 1 for j in range(30)] for i in range(30)]
    assert np.array_equal(edges.endpoints_of(edge), want)


@pytest.mark.parametrize("tile", [11, 64])
def test_links_at_any_tiling(spark, tile):
    edge, g = broken_lines(np.random.default_rng(8), 40)
    want = edges.linked_array(edge, g, 11, 25.0)
    got = array(focal.moving_window(table(spark, edge=edge, gradient=g), ["edge", "gradient"], "link", 11, tile=tile), edge.shape)
    assert (got == want).all() and want.sum() > edge.sum() and (want >= edge).all()


def test_a_gap_is_closed_along_the_gradient():
    edge, g = np.zeros((9, 15), bool), np.full((9, 15), 1.0)
    edge[4, [1, 2, 3, 4, 10, 11, 12]] = True
    g[4, [4, 10]] = g[3, [5, 9]] = g[2, [6, 7, 8]] = 90
    out = edges.linked_array(edge, g, 15, 25.0)
    assert set(map(tuple, np.argwhere(out & ~edge).tolist())) == {(3, 5), (2, 6), (2, 7), (2, 8), (3, 9)}
    assert (edges.linked_array(edge, g, 15, 91.0) == edge).all()  # too weak
    assert (edges.linked_array(edge, g, 11, 25.0) == edge).all()  # too far
    side = np.zeros((9, 15), bool)
    side[[1, 2, 6, 7], [3, 3, 9, 9]] = True
    side[[5, 4], 3] = True
    assert edges.linked_array(side, g, 7, 0.5)[3, 3]  # the endpoint straight ahead, not one farther off


def extended(edge, ends, g, direction, size):
    """Cells choose endpoints and endpoints cells, one by one."""
    half, choice = size // 2, {}
    for i, j in np.ndindex(edge.shape):
        if not edge[i, j] and g[i, j] >= 25:
            seen = []
            for a in range(-half, half + 1):
                for b in range(-half, half + 1):
                    p, q = i + a, j + b
                    if (a, b) != (0, 0) and 0 <= p < edge.shape[0] and 0 <= q < edge.shape[1] and ends[p, q] and direction[p, q] == direction[i, j] and g[p, q] >= 25 and abs(g[p, q] - g[i, j]) < 25:
                        seen.append((abs(g[p, q] - g[i, j]), a * a + b * b, a, b))
            if seen:
                choice[i, j] = min(seen)
    out = edge.copy()
    for p, q in np.argwhere(ends).tolist():
        seen = [(*c, i, j) for (i, j), c in choice.items() if (i + c[2], j + c[3]) == (p, q)]
        if seen:
            out[min(seen)[-2:]] = True
    return out


@pytest.mark.parametrize("tile", [9, 64])
def test_extended_endpoints(spark, tile):
    rng = np.random.default_rng(5)
    edge = rng.random((25, 27)) < 0.15
    ends, g, direction = edges.endpoints_of(edge), rng.integers(0, 80, edge.shape).astype(float), rng.choice([0.0, 45.0], edge.shape)
    want = extended(edge, ends, g, direction, 5)
    assert want.sum() > edge.sum()
    cells = table(spark, edge=edge, end=ends, gradient=g, direction=direction)
    assert (array(focal.moving_window(cells, ["edge", "end", "gradient", "direction"], "extend-endpoints", 5, tile=tile), edge.shape) == want).all()
