"""Random forests whose nodes stay in tables: neither trees nor their statistics pass through the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.sources.scratch import written

GROUP = 1 << 16  # rows of a node above which it is divided by partial counts, below which a task grows all under it
SCORED = 1 << 18  # rows that a task scores at once
NODES = 4096  # nodes whose counts are held at once
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])  # how often a bootstrap draws a row


def _random(*keys) -> np.ndarray:
    """Numbers of 0 to 1 that depend on whole numbers alone, which broadcast."""
    x = np.zeros(1, np.uint64)
    for k in keys:
        x = (x ^ np.asarray(k).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / 2.0**53


def _subsets(seed, tree, node, features: int) -> np.ndarray:
    """The features that each node may be divided by: the root of their number, rounded up."""
    u = _random(seed, np.asarray(tree)[:, None], np.asarray(node)[:, None], np.arange(features))
    return np.argsort(u, 1)[:, : math.ceil(math.sqrt(features))]


def _counts(bins, y, w, n, slot, subset, cuts: int, classes: int) -> np.ndarray:
    """(node, feature, bin, class): sums of weights; behind the classes numbers of rows."""
    f = subset.shape[1]
    at = ((slot[:, None] * f + np.arange(f)) * (cuts + 1) + np.take_along_axis(bins, subset[slot], 1)) * (classes + 1)
    size = len(subset) * f * (cuts + 1) * (classes + 1)
    out = np.bincount((at + y[:, None]).ravel(), np.repeat(w * n, f), size) + np.bincount((at + classes).ravel(), np.repeat(n, f), size)
    return out.reshape(len(subset), f, cuts + 1, classes + 1)


def _best(counts: np.ndarray, leaf: int):
    """(place of the feature or -1, last bin of the left side, gain, rows left, rows right, weights by class) of nodes,
    by the fall of Gini's impurity."""
    cum = counts.cumsum(2)
    total, l = cum[:, :, -1:], cum[:, :, :-1]
    r = total - l
    x, y, t = (a[..., :-1] for a in (l, r, total))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (x**2).sum(-1) / x.sum(-1) + (y**2).sum(-1) / y.sum(-1) - (t**2).sum(-1) / t.sum(-1)
    ok = (l[..., -1] >= leaf) & (r[..., -1] >= leaf) & (x.sum(-1) > 0) & (y.sum(-1) > 0)
    flat = np.where(ok, gain, -np.inf).reshape(len(counts), -1)
    top, each = flat.argmax(1), np.arange(len(counts))
    feature, cut = np.divmod(top, counts.shape[2] - 1)
    found = flat[each, top] > 1e-9 * t[:, 0, 0].sum(-1)
    return np.where(found, feature, -1), cut, np.where(found, flat[each, top], 0.0), l[each, feature, cut, -1], r[each, feature, cut, -1], t[:, 0, 0]


def _grow(bins, y, w, n, tree: int, root: int, spec: dict):
    """(feature, cut, left, share, gain) of the nodes under ``root``, level by level; the right side follows the left.
    Leaves have feature -1; two leaves of one node that say the same are one."""
    parts, nodes, at, start = [], np.array([root]), np.zeros(len(y), np.int64), 0
    while len(nodes):
        last = int(root).bit_length() - 1 + len(parts) >= spec["depth"]
        got = []
        for a in range(0, len(nodes), NODES):
            own = (at >= a) & (at < a + NODES)
            now = nodes[a : a + NODES]
            subset = _subsets(spec["seed"], np.full(len(now), tree), now, bins.shape[1])
            place, cut, gain, _, _, share = _best(_counts(bins[own], y[own], w[own], n[own], at[own] - a, subset, spec["cuts"], spec["classes"]), spec["leaf"])
            if last:
                place = np.full(len(now), -1)
            got.append((np.where(place < 0, -1, subset[np.arange(len(now)), place]), cut, np.where(place < 0, 0.0, gain), share))
        feature, cut, gain, share = (np.concatenate(g) for g in zip(*got))
        split = feature >= 0
        left = np.where(split, 2 * (np.cumsum(split) - 1), 0)
        parts.append([feature, cut, np.where(split, start + len(nodes) + left, 0), share, gain])
        start += len(nodes)
        nodes = np.stack([nodes[split] * 2, nodes[split] * 2 + 1], 1).ravel()
        stay = split[at]
        bins, y, w, n, at = bins[stay], y[stay], w[stay], n[stay], at[stay]
        at = left[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
    for up, down in zip(parts[-2::-1], parts[:0:-1]):
        own = np.flatnonzero(up[0] >= 0)
        says, ends = down[3].argmax(1).reshape(-1, 2), (down[0] < 0).reshape(-1, 2)
        merged = own[ends.all(1) & (says[:, 0] == says[:, 1])]
        up[0][merged], up[4][merged] = -1, 0.0
    return [np.concatenate(p) for p in zip(*parts)]


def _route(bins, trees: int, top) -> np.ndarray:
    """The node of each row in each tree, below the divisions that are known."""
    keys, feature, cut = top
    tree, node = np.arange(trees, dtype=np.int64) << 32, np.ones((len(bins), trees), np.int64)
    if not len(keys):
        return node
    while True:
        at = np.searchsorted(keys, tree + node).clip(max=len(keys) - 1)
        hit = keys[at] == tree + node
        if not hit.any():
            return node
        node = np.where(hit, 2 * node + (np.take_along_axis(bins, feature[at], 1) > cut[at]), node)


def _binned(x: pa.Array, cuts: list) -> np.ndarray:
    """Which range of its feature each value falls into; what is no number goes to the last."""
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(cuts))
    return np.stack([np.searchsorted(c, rows[:, k]) for k, c in enumerate(cuts)], 1).astype(np.int64)


def _packed(bins: np.ndarray) -> pa.Array:
    ends = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins.astype(np.uint8).tobytes())])


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1).astype(np.int64)


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """A classifier of labels 0, 1, 2 and so on by Gini trees of bootstraps, each node of a root of the features, which
    are cut at ``bins`` - 1 quantiles (256 bins at most), as MLlib's.

    Nodes of more than ``GROUP`` rows are divided by counts that partitions add up, only their divisions come to the
    driver; of the others a task each grows all that is under them, and the trees are a table."""

    def __init__(self, trees: int = 100, depth: int = 25, leaf: int = 5, seed: int = 1, bins: int = 32):
        super().__init__()
        self.trees, self.depth, self.leaf, self.seed, self.bins = trees, min(30, depth), leaf, seed, bins

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setWeightCol(self, value: str):
        return self._set(weightCol=value)

    def _cuts(self, rows: DataFrame, features: int) -> list[np.ndarray]:
        """Ends of bins: all values where a thousand quantiles are few values, else quantiles."""
        q = F.array(*(F.lit(k / 1024) for k in range(1025)))
        out = []
        for v in rows.agg(*(F.percentile_approx(F.col("x")[k], q, 10_000).alias(f"q{k}") for k in range(features))).first():
            v = np.array(v, float)
            v = v[~np.isnan(v)]
            few = np.unique(v)
            c = few[:-1] if len(few) <= self.bins else np.unique(v[np.arange(1, self.bins) * (len(v) - 1) // self.bins])
            out.append(c[c < few[-1]] if len(few) else c)
        return out

    def _fit(self, df: DataFrame) -> ForestModel:
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = df.select(F.col(self.getLabelCol()).cast("int").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x"), weight.cast("double").alias("w"))
        rows = written(rows.withColumn("id", F.monotonically_increasing_id()))
        total, most, features = rows.agg(F.count(F.lit(1)), F.max("y"), F.max(F.size("x"))).first()
        if not total:
            raise ValueError("no rows to learn from")
        cuts = self._cuts(rows, features)
        spec = {"seed": self.seed, "depth": self.depth, "leaf": self.leaf, "classes": most + 1, "cuts": max(1, *map(len, cuts))}
        trees = np.arange(self.trees)
        top, ends = self._top(rows, cuts, spec, total)
        done = np.array(sorted((t << 32) + v for t, v, _ in ends), np.int64)

        def deal(batches):
            for b in batches:
                x, ids = _binned(b.column("x"), cuts), b.column("id").to_numpy()
                node, times = _route(x, len(trees), top), np.searchsorted(_POISSON, _random(spec["seed"], ids[:, None], trees), side="right")
                for t in trees:
                    k = np.flatnonzero((times[:, t] > 0) & ~np.isin((int(t) << 32) + node[:, t], done))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t, np.int32)), pa.array(node[k, t]), b.column("y").take(pa.array(k)), b.column("w").take(pa.array(k)), pa.array(times[k, t].astype(np.int32)), _packed(x[k])], ["tree", "node", "y", "w", "times", "bins"])

        def grow(key, pdf):
            f, c, left, share, gain = _grow(_unpacked(pdf.bins), pdf.y.to_numpy().astype(np.int64), pdf.w.to_numpy(), pdf.times.to_numpy(), int(key[0]), int(key[1]), spec)
            worth = np.bincount(np.maximum(f, 0), gain, features)
            return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "feature": [f.astype(np.int32).tobytes()], "cut": [c.astype(np.int32).tobytes()], "left": [left.astype(np.int32).tobytes()], "share": [share.astype(np.float64).tobytes()], "worth": [worth.tolist()]})

        spark, schema = df.sparkSession, "tree int, node bigint, feature binary, cut binary, left binary, share binary, worth array<double>"
        dealt = rows.mapInArrow(deal, "tree int, node bigint, y int, w double, times int, bins binary")
        # a fixed number of parts: the rows are few bytes for the work that they make
        dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", "node")
        grown = dealt.groupBy("tree", "node").applyInPandas(grow, schema)
        one = np.array([-1, 0, 0], np.int32)
        stumps = [(t, v, *(one[k : k + 1].tobytes() for k in range(3)), share.tobytes(), [0.0] * features) for t, v, share in ends]
        table = written(grown.unionByName(spark.createDataFrame(stumps, schema)) if stumps else grown)
        return ForestModel(table, top, cuts, self.trees, most + 1, self.getFeaturesCol())

    def _top(self, rows: DataFrame, cuts: list, spec: dict, total: int):
        """((keys, features, cuts) of the divisions of nodes of more than ``GROUP`` rows, [(tree, node, weights)] of
        such nodes that can't be divided)."""
        seed, trees, features = self.seed, np.arange(self.trees), len(cuts)
        known, ends = {}, []
        live = [(int(t), 1) for t in trees] if total > GROUP else []
        as_arrays = lambda: (np.array(sorted(known), np.int64), *(np.array([known[k][i] for k in sorted(known)], np.int64) for i in (0, 1)))
        while live:
            below, top = [], as_arrays()
            for a in range(0, len(live), NODES):
                now = np.array(sorted((t << 32) + v for t, v in live[a : a + NODES]), np.int64)
                subset = _subsets(seed, now >> 32, now & 0xFFFFFFFF, features)

                def count(batches):
                    out = 0
                    for b in batches:
                        x, ids = _binned(b.column("x"), cuts), b.column("id").to_numpy()
                        y, w = b.column("y").to_numpy().astype(np.int64), b.column("w").to_numpy()
                        node, times = _route(x, len(trees), top), np.searchsorted(_POISSON, _random(seed, ids[:, None], trees), side="right")
                        key = (trees.astype(np.int64) << 32) + node
                        at = np.searchsorted(now, key).clip(max=len(now) - 1)
                        i, t = np.nonzero((now[at] == key) & (times > 0))
                        out = out + _counts(x[i], y[i], w[i], times[i, t], at[i, t], subset, spec["cuts"], spec["classes"])
                    if np.ndim(out):
                        yield pa.RecordBatch.from_arrays([pa.array(now), pa.array([c.tobytes() for c in out], pa.binary())], ["key", "counts"])

                def best(key, pdf):
                    own = subset[np.searchsorted(now, int(key[0]))]
                    c = sum(np.frombuffer(b) for b in pdf.counts).reshape(1, len(own), spec["cuts"] + 1, spec["classes"] + 1)
                    place, cut, _, left, right, share = (v[0] for v in _best(c, spec["leaf"]))
                    return pd.DataFrame({"key": [key[0]], "feature": [own[place] if place >= 0 else -1], "cut": [cut], "left": [int(left)], "right": [int(right)], "share": [share.tolist()]})

                got = rows.mapInArrow(count, "key bigint, counts binary").groupBy("key").applyInPandas(best, "key bigint, feature int, cut int, left bigint, right bigint, share array<double>")
                for r in got.collect():
                    t, v = r.key >> 32, r.key & 0xFFFFFFFF
                    if r.feature < 0 or v.bit_length() > spec["depth"]:
                        ends.append((t, v, np.array(r.share)))
                        continue
                    known[r.key] = (r.feature, r.cut)
                    below += [(t, 2 * v + side) for side, n in ((0, r.left), (1, r.right)) if n > GROUP]
            live = below
        return as_arrays(), ends


class ForestModel(Model):
    """``table`` has a row for each tree and node below the divisions of ``top``: all that was grown under it."""

    def __init__(self, table: DataFrame, top, cuts: list, trees: int, classes: int, features: str):
        super().__init__()
        self.table, self.top, self.cuts, self.trees, self.classes, self.features = table, top, cuts, trees, classes, features

    @property
    def featureImportances(self) -> DenseVector:
        """The fall of impurity by each feature's divisions below ``top``: its share of a tree's, the mean over trees."""
        got = self.table.groupBy("tree").agg(*(F.sum(F.col("worth")[k]).alias(f"w{k}") for k in range(len(self.cuts)))).collect()
        w = np.array([list(r)[1:] for r in got])
        w = (w / np.maximum(w.sum(1, keepdims=True), 1e-300)).sum(0)
        return DenseVector(w / max(w.sum(), 1e-300))

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, ``probability`` and ``prediction``; each row goes to its node's row of the table."""
        base = written(df.withColumn("__id", F.monotonically_increasing_id()))
        cuts, trees, top, classes = self.cuts, self.trees, self.top, self.classes
        parts = -(-base.count() // SCORED) or 1

        def deal(batches):
            for b in batches:
                x, ids = _binned(b.column("x"), cuts), b.column("__id").to_numpy()
                node, packed, part = _route(x, trees, top), _packed(x), (_random(ids) * parts).astype(np.int32)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(node[:, t]), pa.array(part), b.column("__id"), packed], ["tree", "node", "part", "__id", "bins"])

        def score(rows, model):
            if not len(rows) or not len(model):
                return pd.DataFrame({"__id": np.zeros(0, np.int64)} | {f"s{c}": np.zeros(0) for c in range(classes)})
            m = model.iloc[0]
            feature, cut, left = (np.frombuffer(m[c], np.int32) for c in ("feature", "cut", "left"))
            share = np.frombuffer(m["share"]).reshape(len(feature), classes)
            x, at = _unpacked(rows.bins), np.zeros(len(rows), np.int64)
            while (feature[at] >= 0).any():
                f = feature[at]
                at = np.where(f >= 0, left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]), at)
            s = share[at] / np.maximum(share[at].sum(1, keepdims=True), 1e-300)
            return pd.DataFrame({"__id": rows["__id"]} | {f"s{c}": s[:, c] for c in range(classes)})

        by = ["tree", "node", "part"]
        rows = base.select("__id", vector_to_array(self.features).alias("x")).mapInArrow(deal, "tree int, node bigint, part int, __id bigint, bins binary")
        model = self.table.drop("worth").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        names = [f"s{c}" for c in range(classes)]
        votes = rows.groupBy(*by).cogroup(model.groupBy(*by)).applyInPandas(score, "__id bigint, " + ", ".join(f"{n} double" for n in names))
        votes = votes.groupBy("__id").agg(F.array(*(F.sum(n) for n in names)).alias("__s"))
        sums = F.aggregate("__s", F.lit(0.0), lambda a, v: a + v)
        out = base.join(votes, "__id", "left").withColumn("__p", F.transform("__s", lambda v: v / sums))
        return out.select(
            *df.columns,
            array_to_vector("__s").alias("rawPrediction"),
            array_to_vector("__p").alias("probability"),
            (F.array_position("__s", F.array_max("__s")) - 1).cast("double").alias("prediction"),
        )
