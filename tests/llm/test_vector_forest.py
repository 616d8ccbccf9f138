import numpy as np
import pytest

from gridlake.llm import vector_forest as vf
from tests.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, x string, rep string, leaf string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, least=0.9):
    """{id: (links, component)} of rows with distinct ids."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)]
    x = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok}
    near = {i: {j for j in x if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least} for i in x}
    out, seen = {i: (0, i) for i, _ in rows}, set()
    for i in sorted(x):
        todo = [i] if i not in seen else []
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                out[k] = (len(near[k]), i)
                todo += near[k]
    return out, near


def got(df):
    rows = df.collect()
    assert len({r.vec_id for r in rows}) == len(rows) and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def borderline(rng, n, dim, low=0.9, high=0.92):
    """Pairs of unit vectors whose cosine is between the bounds."""
    a, b = (vf.unit(rng.standard_normal((n, dim))) for _ in range(2))
    b = vf.unit(b - (a * b).sum(1, keepdims=True) * a)
    c = rng.uniform(low + 1e-4, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * b


def test_whole_table(spark):
    e = table(spark, "embeddings")
    assert got(vf.near_duplicates(e)) == brute([(r.vec_id, r.embedding) for r in e.collect()])[0]


def test_links_at_any_leaf_size(spark, monkeypatch):
    """Pairs just above and below the bound, groups of near copies in leaves of several blocks, and copies, in deep trees."""
    monkeypatch.setattr(vf, "LEAF", 16)
    rng = np.random.default_rng(5)
    a, b = borderline(rng, 100, 24)
    c, d = borderline(rng, 100, 24, 0.85, 0.899)
    group = vf.unit(rng.standard_normal((1, 24)) + 0.04 * rng.standard_normal((150, 24)))
    rows = list(enumerate(np.concatenate([a, b, c, d, group, group[:20], group[:20]]).tolist()))
    want, near = brute(rows)
    made = got(vf.near_duplicates(vectors(spark, rows), block=40, sample=200))
    found, every = sum(n for n, _ in made.values()), sum(len(v) for v in near.values())
    assert all(made[i][0] <= want[i][0] for i in want)
    assert found >= 0.95 * every and {k: made[k] for k in range(400, 590)} == {k: want[k] for k in range(400, 590)}


def test_recall_of_borderline_pairs():
    """Of pairs at the bound, in trees as deep as a table of a million vectors has, nine of ten share a leaf."""
    rng = np.random.default_rng(1)
    a, b = borderline(rng, 400, 64, 0.9, 0.901)
    depth = vf.depth_for(1_000_000)
    forest = vf.Forest(64, vf.trees_for(depth), depth, 1).fit(rng.standard_normal((4000, 64)))
    (ra, la), (rb, lb) = forest.leaves(a), forest.leaves(b)
    together = np.intersect1d(ra * (1 << 54) + la, rb * (1 << 54) + lb) >> 54
    assert len(np.unique(together)) >= 0.9 * len(a)
    assert len(ra) < 6 * forest.trees * len(a)  # copies that the overlap makes


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [1, nan]), (5, [inf, 1]), (6, [1, None]), (7, [1, 0]), (8, [2, 0]), (9, [1e38, 0]), (10, [1, 0, 0]), (11, [1, 0]), (12, [-1, 0]), (13, [0.9, 0.43]), (14, [0.6, 0.8]), (15, [1e-40, 0]), (None, [1, 0])]
    want, _ = brute(rows)
    want[None] = (0, None)
    assert got(vf.near_duplicates(vectors(spark, rows))) == want
    assert vf.near_duplicates(vectors(spark, [])).count() == 0
    twice = vf.near_duplicates(vectors(spark, [(1, [1, 2]), (1, [1, 2]), (2, [3, 1])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_a_third_are_one_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 else rng.standard_normal(8)) for i in range(3000)]
    assert got(vf.near_duplicates(vectors(spark, rows)))[1][0] >= 1999


@pytest.mark.parametrize("least", [-1.5, 2])
def test_all_and_none(spark, least):
    rows = [(i, [np.cos(i), np.sin(i)]) for i in range(30)]
    assert set(got(vf.near_duplicates(vectors(spark, rows), least=least)).values()) == ({(29, 0)} if least < 0 else {(0, i) for i in range(30)})
