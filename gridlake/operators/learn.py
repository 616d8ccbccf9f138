"""Models: a registry over MLlib, voting, tuning, outliers and scoring of grids."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.forest import Forest
from gridlake.operators.neighbours import propagated  # noqa: F401  one of the learners
from gridlake.operators.sampling import order, split
from gridlake.sources.scratch import written

TREES, DEPTH, LEAF, RATE = 100, 25, 5, 0.1


def _forest(**how):
    return Forest(how.get("trees", TREES), how.get("depth", DEPTH), how.get("leaf", LEAF), how.get("seed", 1))


def _boosted(**how):
    return C.OneVsRest(classifier=C.GBTClassifier(maxIter=how.get("trees", 10), maxDepth=min(10, how.get("depth", 5)), stepSize=how.get("rate", RATE), seed=how.get("seed", 1)))


#: Model code -> estimator. Kernel machines are linear here, and extremely random trees are random forests.
MODELS = {
    **dict.fromkeys(("rf", "ex-rf", "bag-dt", "bag-ex-dt"), _forest),
    **dict.fromkeys(("dt", "ex-dt"), lambda **how: C.DecisionTreeClassifier(maxDepth=min(30, how.get("depth", DEPTH)), minInstancesPerNode=how.get("leaf", LEAF))),
    **dict.fromkeys(("gb", "ab-rf", "ab-ex-rf", "ab-dt", "ab-ex-dt", "xgboost", "lightgbm", "catboost"), _boosted),
    "bayes": lambda **how: C.NaiveBayes(modelType="gaussian"),
    "logistic": lambda **how: C.LogisticRegression(maxIter=how.get("steps", 100), regParam=1 / how["C"] if how.get("C") else 0.0),
    **dict.fromkeys(("svmc", "svmnu", "cvsvm", "cvsvmr"), lambda **how: C.OneVsRest(classifier=C.LinearSVC(maxIter=how.get("steps", 50)))),
    "mlp": lambda **how: C.MultilayerPerceptronClassifier(layers=how["layers"], seed=how.get("seed", 1)),
    **dict.fromkeys(("rfr", "ex-rfr", "bag-dtr", "bag-ex-dtr"), lambda **how: R.RandomForestRegressor(numTrees=how.get("trees", TREES), maxDepth=min(30, how.get("depth", DEPTH)), seed=how.get("seed", 1))),
    **dict.fromkeys(("dtr", "ex-dtr"), lambda **how: R.DecisionTreeRegressor(maxDepth=min(30, how.get("depth", DEPTH)))),
    **dict.fromkeys(("gbr", "ab-dtr", "ab-ex-dtr"), lambda **how: R.GBTRegressor(maxIter=how.get("trees", 10), stepSize=how.get("rate", RATE), seed=how.get("seed", 1))),
}
UNSUPPORTED = ("gaussian", "tpot", "mondrian", "chaincrf", "gridcrf", "c5", "cubist", "blag", "blaf", "blab")


def models() -> list[str]:
    return sorted(MODELS)


def estimator(code: str, label: str, features: list[str], scale: bool = False, **how) -> Pipeline:
    """A pipeline of assembling, scaling if asked for, and the model. ValueError for codes without an equivalent."""
    if code not in MODELS:
        raise ValueError(f"no model {code!r}" + (": it has no distributed equivalent here" if code in UNSUPPORTED else ""))
    steps = [VectorAssembler(inputCols=features, outputCol="__raw" if scale else "features", handleInvalid="keep")]
    if scale:
        steps.append(RobustScaler(inputCol="__raw", outputCol="features", lower=0.05, upper=0.95, withCentering=True))
    model = MODELS[code](**how).setFeaturesCol("features").setLabelCol(label)
    return Pipeline(stages=[*steps, model])


def predict(model: PipelineModel, pixels: DataFrame, features: list[str], background: float = 0.0) -> DataFrame:
    """Rows of ``pixels`` with ``prediction``, 0 where all features are ``background``."""
    empty = F.forall(F.array(*map(F.col, features)), lambda v: v == background)
    return model.transform(pixels).withColumn("prediction", F.when(empty, 0.0).otherwise(F.col("prediction"))).drop("features", "__raw")


def voted(probabilities: list[Column], weights: list[float] | None = None) -> tuple[Column, Column]:
    """(class index, its probability) of the weighted mean of probability arrays; of ties the first class."""
    w = weights or [1.0] * len(probabilities)
    total = F.transform(probabilities[0], lambda v: v * w[0])
    for p, x in zip(probabilities[1:], w[1:]):
        total = F.zip_with(total, p, (lambda x: lambda a, b: a + b * x)(x))
    mean = F.transform(total, lambda v: v / sum(w))
    return (F.array_position(mean, F.array_max(mean)) - 1).cast("double"), F.array_max(mean)


def probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))


def weighted_f1(predictions: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="weightedFMeasure").evaluate(predictions)


def cross_validation(df: DataFrame, key: str, label: str, features: list[str], code: str = "rf", folds: int = 3, share: float = 0.7, **how) -> list[float]:
    """Weighted F1 on the rest of each of several exact, stratified splits."""
    out = []
    for k in range(folds):
        parts = split(df, key, label, share, seed=k + 1)
        m = estimator(code, label, features, **how).fit(parts.where("part = 'train'"))
        out.append(weighted_f1(m.transform(parts.where("part = 'test'")), label))
    return out


def grid_search(df: DataFrame, key: str, label: str, features: list[str], code: str, grid: dict[str, list], folds: int = 2) -> tuple[dict, DataFrame]:
    """(best parameters, a row for each combination with its mean score); of ties the first combination."""
    rows = []
    for values in product(*grid.values()):
        how = dict(zip(grid, values))
        rows.append((str(how), float(np.mean(cross_validation(df, key, label, features, code, folds, **how)))))
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    return dict(zip(grid, list(product(*grid.values()))[best])), df.sparkSession.createDataFrame(rows, "parameters string, score double")


def eliminate(df: DataFrame, key: str, label: str, features: list[str], code: str = "rf", least: int = 2, **how) -> list[tuple[list[str], float]]:
    """(features, score) as the least important feature goes, one at a time."""
    out, now = [], list(features)
    while len(now) >= least:
        parts = split(df, key, label, 0.7)
        m = estimator(code, label, now, **how).fit(parts.where("part = 'train'"))
        out.append((list(now), weighted_f1(m.transform(parts.where("part = 'test'")), label)))
        rank = m.stages[-1].featureImportances.toArray()
        now.pop(int(rank.argmin()))
    return out


def components(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """``df`` with ``pca``: the first k components of the standardised features, as an array."""
    p = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__a"), StandardScaler(inputCol="__a", outputCol="__b", withMean=True), PCA(k=k, inputCol="__b", outputCol="__c")]).fit(df)
    return p.transform(df).withColumn("pca", vector_to_array("__c")).drop("__a", "__b", "__c")


def _distances(stats: dict, label: str, features: list[str]) -> Column:
    """The squared Mahalanobis distance of a row by its label's {label: (centre, covariance)}."""
    d = F.lit(None).cast("double")
    for value, (centre, cov) in stats.items():
        inv = np.linalg.pinv(cov + 1e-9 * np.eye(len(cov)))
        z = [F.col(f) - float(m) for f, m in zip(features, centre)]
        own = sum((z[i] * z[j] * float(inv[i, j]) for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
        d = F.when(F.col(label).eqNullSafe(F.lit(value)), own).otherwise(d)
    return d


def _moments(df: DataFrame, label: str, features: list[str]) -> dict:
    """{label: (mean, covariance)} by one aggregate of sums."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    got = df.groupBy(label).agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).collect()
    return {r[label]: (np.array([r[f"m_{f}"] for f in features]), np.array([[r[f"c_{a}_{b}"] if (a, b) in pairs else r[f"c_{b}_{a}"] for b in features] for a in features])) for r in got}


ACCURACY = 10_000  # of quantile sketches, which are exact for fewer rows


def robust_moments(df: DataFrame, label: str, features: list[str], support: float = 0.75, steps: int = 30) -> dict:
    """{label: (centre, covariance)} of the ``support`` share of each label's rows that lie closest together: the
    minimum covariance determinant by concentration steps.

    Begins with medians and median deviations; each step takes the rows within the quantile of the distances, from a
    sketch, and their mean and covariance, all by partial sums, until no determinant falls any more."""
    mid = df.groupBy(label).agg(*(F.percentile_approx(f, 0.5, ACCURACY).alias(f"m{k}") for k, f in enumerate(features))).collect()
    centres = {r[label]: np.array([r[f"m{k}"] for k in range(len(features))], float) for r in mid}
    off = {f"d{k}": F.abs(F.col(f) - _by_label(label, {v: c[k] for v, c in centres.items()})) for k, f in enumerate(features)}
    spread = df.withColumns(off).groupBy(label).agg(*(F.percentile_approx(f"d{k}", 0.5, ACCURACY).alias(f"m{k}") for k in range(len(features)))).collect()
    stats = {r[label]: (centres[r[label]], np.diag([max((r[f"m{k}"] * 1.4826) ** 2, 1e-12) for k in range(len(features))])) for r in spread}
    was = dict.fromkeys(stats, np.inf)
    for _ in range(steps):
        ranked = df.withColumn("__d", _distances(stats, label, features))
        cut = {r[label]: r.cut for r in ranked.groupBy(label).agg(F.percentile_approx("__d", support, ACCURACY).alias("cut")).collect()}
        stats = _moments(ranked.where(F.col("__d") <= _by_label(label, cut)), label, features)
        size = {v: float(np.linalg.slogdet(c + 1e-12 * np.eye(len(c)))[1]) for v, (_, c) in stats.items()}
        if all(size[v] >= was[v] - 1e-9 for v in size):
            break
        was = size
    return stats


def _by_label(label: str, values: dict) -> Column:
    out = F.lit(None).cast("double")
    for v, x in values.items():
        out = F.when(F.col(label).eqNullSafe(F.lit(v)), float(x)).otherwise(out)
    return out


def without_outliers(df: DataFrame, key: str, label: str, features: list[str], share: float = 0.1, robust: bool = False, support: float = 0.75) -> DataFrame:
    """Rows less the ``share`` of each label's that lie farthest from its centre by its covariance, of all its rows or,
    ``robust``, of those that lie closest together (see ``robust_moments``).

    Each row's distance is an expression over its own label's moments. The rows that stay are exact in number: quantile
    sketches cut distances into ranges, and rows are ranked within the ranges only. Rows with a null feature have no
    distance, and are the first to go. Labels must be few enough to have a row each on the driver."""
    stats = robust_moments(df, label, features, support) if robust else _moments(df, label, features)
    ranked = df.withColumn("__d", F.coalesce(_distances(stats, label, features), F.lit(float("inf"))))
    cuts = ranked.groupBy(label).agg(F.percentile_approx("__d", F.array(*(F.lit(k / 64) for k in range(1, 64))), ACCURACY).alias("__cuts")).withColumnRenamed(label, "__of")
    ranked = ranked.join(cuts, F.col(label).eqNullSafe(F.col("__of"))).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__d")))).drop("__cuts", "__of")
    sizes = ranked.groupBy(label, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy(label)
    left = F.ceil(F.round(F.sum("__rows").over(w) * (1 - share), 6)) - F.coalesce(F.sum("__rows").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(label).alias("__of"), F.col("__range").alias("__r"), left.alias("__left"))
    place = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__d", key))
    out = ranked.withColumn("__place", place).join(sizes, F.col(label).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__r")))
    return out.where(F.col("__place") <= F.col("__left")).select(*(df[c] for c in df.columns))


class Calibrated:
    """A model and a curve for each class that turns its scores into shares of rows that are of the class."""

    def __init__(self, model: PipelineModel, curves: list, method: str):
        self.model, self.curves, self.method = model, curves, method

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``, an array that adds up to 1, and ``prediction``, its largest; of ties the first."""
        out = self.model.transform(df).withColumn("__p", probability()).drop("features", "__raw", "rawPrediction", "probability", "prediction")
        parts = []
        for c, curve in enumerate(self.curves):
            out = out.withColumn("__x", F.col("__p")[c])
            if self.method == "isotonic":
                out = curve.transform(out).withColumnRenamed("prediction", f"__c{c}")
            else:
                a, b = curve
                out = out.withColumn(f"__c{c}", 1 / (1 + F.exp(-(_logit(F.col("__x")) * a + b))))
            parts.append(F.col(f"__c{c}"))
        total = sum(parts, F.lit(0.0))
        even = F.array(*(F.lit(1.0 / len(parts)) for _ in parts))
        p = F.when(total > 0, F.array(*(x / F.when(total > 0, total) for x in parts))).otherwise(even)
        out = out.withColumn("probability", p).drop("__p", "__x", *(f"__c{c}" for c in range(len(parts))))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def calibrated(df: DataFrame, key: str, label: str, features: list[str], code: str = "rf", method: str = "isotonic", folds: int = 3, weight: str | None = None, **how) -> Calibrated:
    """A model whose probabilities are calibrated on rows that it wasn't fitted on; labels are 0, 1, 2 and so on.

    Rows are dealt into folds by a digest of their key; each fold is scored by a model of the others, and for each class
    a curve is fitted to those scores: ``isotonic`` (the best that never falls) or ``sigmoid`` (a logistic one of the
    log-odds). The model itself is then fitted on all rows. ``weight`` names a column of sample weights, which models
    and curves take."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"no calibration {method!r}")

    def fitted(rows):
        e = estimator(code, label, features, **how)
        if weight:
            e.getStages()[-1].setWeightCol(weight)
        return e.fit(rows)

    fold = F.pmod(order(key), F.lit(folds))
    parts = [fitted(df.where(fold != k)).transform(df.where(fold == k)).select(F.col(label).cast("double").alias("y"), probability().alias("p"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")) for k in range(folds)]
    scored = written(reduce(DataFrame.unionByName, parts))
    curves = []
    for c in range(int(scored.agg(F.max(F.size("p"))).first()[0])):
        own = scored.select(F.col("p")[c].alias("__x"), (F.col("y") == c).cast("double").alias("y"), "w")
        if method == "isotonic":
            curves.append(R.IsotonicRegression(featuresCol="__x", labelCol="y", weightCol="w").fit(own))
        else:
            one = VectorAssembler(inputCols=["s"], outputCol="v").transform(own.withColumn("s", _logit(F.col("__x"))))
            m = C.LogisticRegression(featuresCol="v", labelCol="y", weightCol="w").fit(one) if own.agg(F.countDistinct("y")).first()[0] > 1 else None
            curves.append((float(m.coefficients[0]), float(m.intercept)) if m else (0.0, 40.0 if own.where("y = 1").limit(1).count() else -40.0))
    return Calibrated(fitted(df), curves, method)


def calibration_error(df: DataFrame, p: Column, hit: Column, bins: int = 10) -> float:
    """The mean difference of predicted and true shares over bins of the prediction, by their rows."""
    b = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.avg(p).alias("p"), F.avg(hit.cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    return float(b.agg(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n")).first()[0])
