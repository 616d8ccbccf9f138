"""Nearest neighbours in feature space, and labels that spread over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.sampling import order
from gridlake.sources.scratch import written

SAMPLE = 8192  # rows that place the splits of the trees
LEAF = 256  # rows of a leaf, on average
BLOCK = 1024  # rows of a leaf that a group compares with as many others
TREES = 12


class Trees:
    """Random splits: a direction for each tree and level, and each node's median of a sample's projections on it."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int):
        self.depth = depth
        self.centre, self.scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale[self.scale == 0] = 1
        self.directions = np.random.default_rng(seed).standard_normal((trees, depth, x.shape[1]))
        self.medians = np.zeros((trees, 1 << depth))
        for tree in range(trees):
            p, node = self._projected(x, tree), np.ones(len(x), np.int64)
            for level in range(depth):
                for own in np.unique(node):
                    self.medians[tree, own] = np.median(p[node == own, level])
                node = 2 * node + (p[:, level] >= self.medians[tree, node])

    def _projected(self, x: np.ndarray, tree: int) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.directions[tree].T

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(row, tree) -> leaf number, different for each tree."""
        out = []
        for tree in range(len(self.directions)):
            p, node = self._projected(x, tree), np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (p[:, level] >= self.medians[tree, node])
            out.append(node + (tree << 40))
        return np.stack(out, 1)


def nearest_rows(df: DataFrame, key: str, features: list[str], k: int = 5, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(a, b, place, distance): for each row, by its key, the ``k`` nearest others, place 1 the nearest; of equal
    distances the least key. Approximate where the table has more than one leaf: neighbours are those that share a leaf
    of one of several random trees. One leaf, of ``leaf`` rows or fewer, makes it exact.

    Trees are placed by about ``SAMPLE`` rows chosen by a digest of their keys; all rows go down them. A leaf of more
    than twice ``block`` rows is cut into blocks whose pairs are compared each in a group of its own, so no task holds a
    large leaf. Each group sends on a row's nearest ``k`` only. Keys must be distinct bigints; rows with a null feature
    have no neighbours and are none's."""
    rows = written(df.select(F.col(key).cast("bigint").alias("a"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("a").isNotNull()))
    size = rows.count()
    depth = max(0, math.ceil(math.log2(max(size, 1) / leaf)))
    chosen = rows.where(order("a", seed) < int(min(1.0, SAMPLE / max(size, 1)) * (1 << 60))).select("x").collect() if depth else []
    made = Trees(np.array([r.x for r in chosen], float).reshape(-1, len(features)), trees if depth else 1, depth, seed)

    def send(batches):
        for pdf in batches:
            if len(pdf):
                at = made.leaves(np.stack(pdf.x))
                n = at.shape[1]
                yield pd.DataFrame({"leaf": at.ravel(), "a": np.repeat(pdf.a.to_numpy(), n), "x": np.repeat(pdf.x.to_numpy(), n)})

    sent = written(rows.mapInPandas(send, "leaf bigint, a bigint, x array<double>"))
    large = sent.groupBy("leaf").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 2 * block).select("leaf", F.ceil(F.col("held") / block).cast("int").alias("parts"))
    sent = sent.join(large, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "a", "x")

    def compare(key, pdf):
        _, p, q = key
        ids, x, part = pdf.a.to_numpy(), np.stack(pdf.x), pdf.part.to_numpy()
        out = []
        for s, t in {(p, q), (q, p)}:
            own, others = np.flatnonzero(part == s), np.flatnonzero(part == t)
            for i in range(0, len(own), 256):
                rows_ = own[i : i + 256]
                d = np.sqrt(np.maximum(((x[rows_][:, None, :] - x[others][None]) ** 2).sum(2), 0))
                d[ids[rows_][:, None] == ids[others][None]] = np.inf
                by = np.lexsort((np.broadcast_to(ids[others], d.shape), d))[:, :k]
                near = np.take_along_axis(d, by, 1)
                some = np.isfinite(near)
                out.append(pd.DataFrame({"a": np.repeat(ids[rows_], some.sum(1)), "b": ids[others][by][some], "distance": near[some]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": int, "b": int})

    pairs = sent.groupBy("leaf", "p", "q").applyInPandas(compare, "a bigint, b bigint, distance double").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("a", "b", "place", "distance")


def propagated(df: DataFrame, key: str, label: str, features: list[str], neighbours: int = 5, method: str = "propagate", alpha: float = 0.2, rounds: int = 30, tolerance: float = 1e-3, **how) -> DataFrame:
    """(key, label) with labels of -1 replaced by what spreads to them over nearest neighbours.

    Rows hold shares of the classes, at first 1 of their own or nothing. In each round a row takes the mean of its
    neighbours' shares; with ``propagate`` labelled rows keep theirs, with ``spread`` all rows take ``alpha`` of it and
    1 - ``alpha`` of what they began with. Rounds, each a join and partial sums, end when no share changes by more than
    ``tolerance``, or after ``rounds``. The largest share names the class, of equal ones the least class; labelled rows
    keep their label, and a row that nothing reaches keeps -1. The graph is ``nearest_rows``, to which ``how`` goes;
    there is no limit of rows."""
    if method not in ("propagate", "spread"):
        raise ValueError(f"no method {method!r}")
    graph = written(nearest_rows(df, key, features, neighbours, **how).select("a", "b"))
    degree = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    graph = written(graph.join(degree, "a"))
    first = written(df.select(F.col(key).cast("bigint").alias("a"), F.col(label).alias("c")).where(F.col("c") != -1).select("a", "c", F.lit(1.0).alias("s")))
    fixed = first.select(F.col("a").alias("known")).distinct()
    now = first
    for _ in range(rounds):
        got = graph.join(now.select(F.col("a").alias("b"), "c", "s"), "b").groupBy("a", "c").agg((F.sum("s") / F.first("n")).alias("s"))
        if method == "propagate":
            new = got.join(fixed, got["a"] == fixed["known"], "left_anti").unionByName(first)
        else:
            new = got.select("a", "c", (F.col("s") * alpha).alias("s")).unionByName(first.select("a", "c", (F.col("s") * (1 - alpha)).alias("s"))).groupBy("a", "c").agg(F.sum("s").alias("s"))
        new = written(new)
        moved = new.join(now.withColumnRenamed("s", "was"), ["a", "c"], "full").where(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) > tolerance)
        now = new
        if not moved.limit(1).count():
            break
    best = now.groupBy("a").agg(F.max(F.struct(F.round("s", 12).alias("s"), (-F.col("c")).alias("c"))).alias("m")).select("a", (-F.col("m.c")).alias("found"))
    out = df.join(best, F.col(key).cast("bigint") == best["a"], "left")
    kind = dict(df.dtypes)[label]
    return out.select(key, F.when(F.col(label) == -1, F.coalesce("found", F.lit(-1))).otherwise(F.col(label)).cast(kind).alias(label))
