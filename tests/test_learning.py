"""Queries over models against numpy."""

import numpy as np
import pytest

from gridlake.plans import learning

SF = "/root/testdata/sf0.001"


def rows(spark):
    got = learning._data(spark, SF).orderBy("vec_id").collect()
    return np.array([r.vec_id for r in got]), np.array([r.label for r in got]), np.array([[r[b] for b in learning.BANDS] for r in got])


def test_components(spark):
    ids, _, x = rows(spark)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    want = z @ axes[:3].T
    got = np.array([[r.c1, r.c2, r.c3] for r in learning.QUERIES["principal_components"](spark, SF).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_outliers(spark):
    ids, y, x = rows(spark)
    want = set()
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        d = x[own, :3] - x[own, :3].mean(0)
        far = np.einsum("ij,jk,ik->i", d, np.linalg.pinv(np.cov(d.T, bias=True) + 1e-9 * np.eye(3)), d)
        want |= set(ids[own[np.argsort(far, kind="stable")[: int(np.ceil(round(len(own) * 0.9, 6)))]]].tolist())
    got = {r.vec_id for r in learning.QUERIES["remove_outliers"](spark, SF).collect()}
    assert got == want


def test_bayes_from_its_formula(spark):
    """Gaussian naive Bayes, row by row."""
    ids, y, x = rows(spark)
    got = {r.vec_id: r for r in learning.QUERIES["classify_bayes"](spark, SF).collect()}
    train = np.array([i not in got for i in ids.tolist()])
    classes = np.unique(y)
    score = []
    floor = 1e-9 * x[train].var(0).max()
    for c in classes:
        own = x[train & (y == c)]
        var = own.var(0) + floor
        score.append(np.log(len(own) / train.sum()) - 0.5 * (np.log(2 * np.pi * var) + (x - own.mean(0)) ** 2 / var).sum(1))
    want = classes[np.argmax(score, 0)]
    same = [got[i].prediction == want[n] for n, i in enumerate(ids.tolist()) if i in got]
    assert np.mean(same) > 0.99


@pytest.mark.parametrize("code", ["rf", "dt", "logistic"])
def test_models_predict(spark, code):
    """A prediction for each test row, among the labels, and not one for all."""
    got = learning.QUERIES[f"classify_{code}"](spark, SF).collect()
    _, y, _ = rows(spark)
    assert len(got) == sum((y == c).sum() - (y == c).sum() // 2 for c in np.unique(y))
    assert {r.prediction for r in got} <= set(y.tolist()) and len({r.prediction for r in got}) > 1


def test_robust_outliers(spark):
    """Nine of ten rows of each label stay, those nearest by numpy's concentration."""
    from tests.test_samples import concentrated

    ids, y, x = rows(spark)
    got = {r.vec_id for r in learning.QUERIES["robust_outliers"](spark, SF).collect()}
    want = set()
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        m, cov = concentrated(x[own, :3])
        d = np.einsum("ij,jk,ik->i", x[own, :3] - m, np.linalg.pinv(cov + 1e-9 * np.eye(3)), x[own, :3] - m)
        want |= set(ids[own[np.argsort(d, kind="stable")[: int(np.ceil(round(len(own) * 0.9, 6)))]]].tolist())
    assert got == want


def test_label_propagation(spark):
    """As numpy's spreading over the true neighbours."""
    from tests.test_neighbours import nearest, spread

    ids, y, x = rows(spark)
    got = {r.vec_id: r.label for r in learning.QUERIES["label_propagation"](spark, SF).collect()}
    want = spread(nearest(x, 5), np.where(ids % 5 == 0, y, -1), "propagate", rounds=10)
    assert len(got) == len(ids) and np.mean([got[i] == w for i, w in zip(ids.tolist(), want)]) > 0.97


def test_calibrated_bayes(spark):
    """A row for each test row; shares are those of labels on the whole, for the labels here have little to do with the bands."""
    got = learning.QUERIES["calibrated_bayes"](spark, SF).collect()
    _, y, _ = rows(spark)
    assert len(got) == sum((y == c).sum() - (y == c).sum() // 2 for c in np.unique(y)) and {r.prediction for r in got} <= set(y.tolist())
    assert abs(np.mean([r.share for r in got]) - np.mean([r.prediction == r.label for r in got])) < 0.1


def _learnt(spark, n, seed):
    """Four labels by two of three features, a tenth of them wrong."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 4, n), (x[:, 0] > 0.4) * 2 + (x[:, 1] > x[:, 0]))
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], "id long, a double, b double, c double, label double")


@pytest.mark.parametrize("group", [1 << 16, 200], ids=["in tasks", "by counts"])
def test_forest_stays_in_tables(spark, monkeypatch, group):
    """As good as MLlib's, whose trees the driver holds, whether tasks grow trees whole or only below divided nodes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from gridlake.operators import forest, learn

    monkeypatch.setattr(forest, "GROUP", group)
    monkeypatch.setattr(forest, "SCORED", 300)
    train, test, names = _learnt(spark, 1500, 1), _learnt(spark, 700, 2), ["a", "b", "c"]
    m = learn.estimator("rf", "label", names, trees=20).fit(train)
    assert isinstance(m.stages[-1], forest.ForestModel) and (len(m.stages[-1].top[0]) > 0) == (group == 200)
    got = m.transform(test).collect()
    share = np.array([r.probability.toArray() for r in got])
    assert sorted(r.id for r in got) == list(range(700)) and np.allclose(share.sum(1), 1) and [r.prediction for r in got] == share.argmax(1).tolist()
    v = VectorAssembler(inputCols=names, outputCol="features")
    plain = RandomForestClassifier(numTrees=20, maxDepth=25, minInstancesPerNode=5, labelCol="label").fit(v.transform(train)).transform(v.transform(test)).collect()
    right = [np.mean([r.prediction == r.label for r in rows]) for rows in (got, plain)]
    assert right[0] > right[1] - 0.03 and right[0] > 0.8
    rank = m.stages[-1].featureImportances.toArray()
    assert rank.argmin() == 2 and rank.sum() == pytest.approx(1)
