"""Sample tables, exact splits, robust outliers and calibrated models."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import learn, samples


def rows(n=900):
    rng = np.random.default_rng(1)
    return [(float(rng.uniform(0, 9000)), float(rng.uniform(0, 9000)), float(rng.random()), float(rng.random()), float(rng.random()), int(rng.integers(0, 4)), int(rng.integers(1, 40)), float(rng.random())) for _ in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "X double, Y double, f1 double, f2 double, f3 double, response int, clear int, weights double")


@pytest.mark.parametrize("end", ["\r", "\n", "\r\n"])
def test_files(spark, tmp_path, end):
    """A byte order mark, and lines that end in any way."""
    (tmp_path / "a.csv").write_bytes(("\ufeffX,Y,1,2,response" + end + end.join(f"{k}.5,{k},0.{k},{k * 2},{k % 3}" for k in range(1, 8)) + end).encode())
    df = samples.read_samples(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["X", "Y", "1", "2", "response"] and dict(df.dtypes)["response"] == "int"
    assert {tuple(r) for r in df.collect()} == {(k + 0.5, k, k / 10, k * 2, k % 3) for k in range(1, 8)}
    samples.write_samples(df, str(tmp_path / "b"))
    assert samples.read_samples(spark, str(tmp_path / "b")).exceptAll(df).count() == 0
    got = samples.split_samples(df)
    assert got.features == ["1", "2"] and got.classes == [0, 1, 2] and got.train.columns == df.columns


def test_one_call(spark):
    data = rows()
    got = samples.split_samples(table(spark, data), clear="clear", least=10, weight="weights", remove=[3], recode={0: 7, 1: 2, 2: 1}, under={"f1": 0.2}, ignore=[2], use_xy=True, share_each=0.4)
    assert got.features == ["f1", "f3", "X", "Y"] and got.classes == [1, 2, 7] and got.weight == "weights"
    left = [(*r[:5], {0: 7, 1: 2, 2: 1}[r[5]], *r[6:]) for r in data if r[5] != 3 and r[6] >= 10 and r[2] >= 0.2]
    train, test = ([tuple(r) for r in df.collect()] for df in (got.train, got.test))
    assert Counter(train + test) == Counter(left)
    size = Counter(r[5] for r in left)
    assert Counter(r[5] for r in train) == {c: int(n * 0.4) for c, n in size.items()}


def test_ways_to_draw(spark):
    data = rows()
    df = table(spark, data)
    size = Counter(r[5] for r in data)
    drawn = lambda **how: [tuple(r) for r in samples.split_samples(df, **how).train.collect()]
    assert len(drawn(share=0.25)) == 225
    assert Counter(r[5] for r in drawn(counts={0: 20, 1: 0.5, 9: 4})) == {0: 20, 1: size[1] // 2}
    both = samples.split_samples(df, against_all=[1, 2], share_each=0.1, limit_test=33)
    assert both.classes == [0, 1] and both.test.count() == 33
    even = Counter((r[5], r[0] // 3000, r[1] // 3000) for r in drawn(counts={c: 36 for c in range(4)}, stratified=True, spacing=3000.0))
    assert len(even) == 36 and max(even.values()) - min(even.values()) <= 1  # 9 squares of 4 classes
    scaled = samples.split_samples(df, scale=True).train.unionByName(samples.split_samples(df, scale=True).test)
    assert scaled.agg(F.avg("f1"), F.stddev_pop("f1")).first()[:] == pytest.approx((0, 1))
    twice = df.unionByName(df)
    assert samples.split_samples(twice, share=0.5).train.count() == 900  # repeated rows
    none = samples.split_samples(df.limit(0))
    assert none.train.count() == none.test.count() == 0 and none.classes == []
    assert samples.split_samples(df.withColumn("response", F.lit(None).cast("int")), share_each=0.5).train.count() == 450


def concentrated(x, support=0.75, steps=30):
    """Mean and covariance of the closest rows, by loops over the whole array."""
    low = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))), 1) - 1]
    m = np.array([low(c, 0.5) for c in x.T])
    cov = np.diag([max((low(np.abs(c - k), 0.5) * 1.4826) ** 2, 1e-12) for c, k in zip(x.T, m)])
    was = np.inf
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(cov + 1e-9 * np.eye(len(cov))), x - m)
        own = x[d <= low(d, support)]
        m, cov = own.mean(0), np.cov(own.T, bias=True)
        size = np.linalg.slogdet(cov + 1e-12 * np.eye(len(cov)))[1]
        if size >= was - 1e-9:
            break
        was = size
    return m, cov


def test_robust_outliers(spark):
    """As numpy's concentration; a planted cluster doesn't move the ellipse, and is what goes."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.multivariate_normal([1, 2], [[2, 1], [1, 1]], 300), rng.multivariate_normal([40, -30], [[0.1, 0], [0, 0.1]], 60), rng.normal(-5, 1, (100, 2))]
    y = [0] * 360 + [1] * 100
    df = spark.createDataFrame([(k, c, *map(float, v)) for k, (c, v) in enumerate(zip(y, x))], "id long, label int, a double, b double")
    got = learn.robust_moments(df, "label", ["a", "b"])
    for c in (0, 1):
        m, cov = concentrated(x[np.array(y) == c])
        assert np.allclose(got[c][0], m) and np.allclose(got[c][1], cov)
    kept = {r.id for r in learn.without_outliers(df, "id", "label", ["a", "b"], 1 / 6, robust=True).collect()}
    assert {k for k in kept if k < 360} == set(range(300)) and len(kept) == 300 + 84
    plain = learn._moments(df, "label", ["a", "b"])
    assert abs(got[0][0][0] - 1) < 0.5 < abs(plain[0][0][0] - 1)
    ties = spark.createDataFrame([(k, 0, 1.0, 1.0 if k else None) for k in range(50)], "id long, label int, a double, b double")
    assert {r.id for r in learn.without_outliers(ties, "id", "label", ["a", "b"], 0.1).collect()} == set(range(1, 46))


def pooled(x, y):
    """The best values that never fall, by joining neighbours that do."""
    order = np.argsort(x, kind="stable")
    groups = [[y[k], 1] for k in order]
    k = 0
    while k < len(groups) - 1:
        if groups[k][0] > groups[k + 1][0]:
            (a, m), (b, n) = groups[k], groups.pop(k + 1)
            groups[k] = [(a * m + b * n) / (m + n), m + n]
            k = max(k - 1, 0)
        else:
            k += 1
    return np.repeat([g[0] for g in groups], [g[1] for g in groups])[np.argsort(order)]


def test_isotonic_curve(spark):
    rng = np.random.default_rng(4)
    x = rng.permutation(200) / 200
    y = (rng.random(200) < x**2).astype(float)
    m = learn.R.IsotonicRegression(featuresCol="x", labelCol="y").fit(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"))
    got = {r.x: r.prediction for r in m.transform(spark.createDataFrame([(v,) for v in x.tolist()], "x double")).collect()}
    assert [got[v] for v in x.tolist()] == pytest.approx(pooled(x, y).tolist())


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_helps(spark, method):
    """Naive Bayes is too sure of features that say the same; on held rows the calibrated one is less wrong."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 3000)
    z = y + rng.normal(0, 1.2, 3000)
    df = spark.createDataFrame([(k, int(c), float(v), float(v + e), float(v - e), 1.0 + k % 2) for k, (c, v, e) in enumerate(zip(y, z, rng.normal(0, 0.1, 3000)))], "id long, label int, a double, b double, c double, w double")
    train, held = df.where("id < 1500"), df.where("id >= 1500")
    features = ["a", "b", "c"]
    error = lambda d, p: learn.calibration_error(d, p, F.col("label") == 1)
    before = error(learn.estimator("bayes", "label", features).fit(train).transform(held), learn.probability()[1])
    made = learn.calibrated(train, "id", "label", features, "bayes", method, weight="w").transform(held)
    assert set(df.columns) | {"probability", "prediction"} == set(made.columns) and made.count() == 1500
    assert error(made, F.col("probability")[1]) < 0.5 * before
    assert made.where(F.abs(F.col("probability")[0] + F.col("probability")[1] - 1) > 1e-9).count() == 0
    assert made.where("prediction = label").count() > 900


def test_compared_samples(spark):
    base = spark.createDataFrame([(k, k % 2, float(10 * (k % 2)), float(k), 1.0 if k < 5 else 0.3) for k in range(20)], "id long, response int, a double, b double, w double")
    later = base.where("id < 19").withColumns({"b": F.when(F.col("id") % 4 == 0, F.col("b") + 100).otherwise(F.col("b") + 1), "response": F.lit(7)})
    got = {r.id: r for r in samples.compared(base, later, "id", ["a", "b"], share=1.0, weight="w").collect()}
    assert set(got) == {k for k in range(19) if k % 4} and all(r.response == 7 and r.w == (2.0 if k < 5 else 0.3) for k, r in got.items())
    assert samples.compared(base, later, "id", ["a", "b"], share=0.5).count() == 19  # one of two is enough
    both = samples.compared(base, later, "id", ["a", "b"], share=1.0, weight="w", add=True)
    assert both.count() == 20 + 14 and both.columns == ["id", "response", "a", "b", "w"]
    mixed = base.withColumn("b", F.when(F.col("id") % 10 == 0, 1e3).otherwise(F.col("b")))
    spread = {r.id: r.response for r in samples.compared(base, mixed, "id", ["a", "b"], share=1.0, spread=True, neighbours=2).collect()}
    assert len(spread) == 20 and all(v == k % 2 for k, v in spread.items() if k % 10) and set(spread.values()) <= {0, 1, -1}
    assert samples.compared(base, later.limit(0), "id", ["a", "b"]).count() == 0
