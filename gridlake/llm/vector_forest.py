"""Near-duplicate vectors by a forest of random projections: overlapping recursive splits, comparison within leaves, union."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.components import components
from gridlake.llm.shared import learn_in_task, materialise

SAMPLE = 16_384  # vectors, or about as many, that place the splits; all vectors go through them
LEAF = 256  # vectors of a leaf, if splits halve and nothing overlapped
SPILL = 0.1  # share of a node's vectors that go to both sides
MARGIN = 0.1  # least distance from a split, times the root of the vectors' length, from which vectors go to one side only
TIGHT = 0.35  # share of a node's vectors that would go to both sides from which it isn't split
FEWEST = 32  # sampled vectors of a node that place its split; under them, all sampled vectors of its level do
KEPT = 0.935  # share of pairs of cosine 0.9 that one split leaves together, at this spill
LEAST_TREES = 8
BLOCK = 1024  # vectors of a leaf that a task compares with as many others
PATH = 40  # bits of a leaf number below those of its tree


def depth_for(n: int) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / LEAF)))


def trees_for(depth: int) -> int:
    """So many that 97 of 100 pairs of cosine 0.9 share a leaf of some tree."""
    together = KEPT**depth
    return LEAST_TREES if together >= 1 else max(LEAST_TREES, math.ceil(math.log(0.03) / math.log(1 - together)))


def _directions(dim: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """A random unit vector for each tree and level."""
    v = np.random.default_rng((seed, dim)).standard_normal((trees * depth, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Where vectors of one length are split: ``cuts[tree]`` holds for a node number (1 for the root, 2 n and 2 n + 1
    below n) the least value that goes right and the value from which none goes left, or infinity for a node whose
    vectors lie too close to be split; ``levels`` has what holds for nodes that too few sampled vectors reached."""

    def __init__(self, dim: int, trees: int, depth: int, seed: int):
        self.dim, self.trees, self.depth, self.seed = dim, trees, depth, seed
        band = 0.12566 / math.sqrt(dim)  # the middle tenth of a random unit vector's projections
        self.levels = np.tile([-band, band], (trees, depth, 1))
        self.cuts = [np.full((2, 2), np.nan) for _ in range(trees)]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) @ _directions(self.dim, self.trees, self.depth, self.seed).T).reshape(len(x), self.trees, self.depth)

    def _descend(self, at: np.ndarray, path: np.ndarray, p: np.ndarray, tree: int, level: int):
        """(rows and nodes below, rows and nodes that stay leaves)."""
        cut, known = np.tile(self.levels[tree, level], (len(at), 1)), self.cuts[tree]
        own = np.flatnonzero(path < len(known))
        fitted = known[path[own]]
        some = ~np.isnan(fitted[:, 0])
        cut[own[some]] = fitted[some]
        v, stays = p[at, tree, level], np.isinf(cut[:, 0])
        left, right = (v < cut[:, 1]) & ~stays, (v >= cut[:, 0]) & ~stays
        return np.r_[at[left], at[right]], np.r_[path[left] * 2, path[right] * 2 + 1], at[stays], path[stays]

    def fit(self, x: np.ndarray) -> Forest:
        p, margin = self.projected(x), MARGIN / math.sqrt(self.dim)

        def cut(v: np.ndarray) -> tuple[float, float]:
            a, m, b = (v[min(int(len(v) * q), len(v) - 1)] for q in (0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2))
            return min(a, m - margin), max(b, m + margin)

        for tree in range(self.trees):
            at, path = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(self.depth):
                self.levels[tree, level] = cut(np.sort(p[:, tree, level]))
                by = np.lexsort((p[at, tree, level], path))
                v, edge = p[at[by], tree, level], np.flatnonzero(np.diff(path[by])) + 1
                grown = np.full((2 << level, 2), np.nan)
                grown[: len(self.cuts[tree])] = self.cuts[tree][: len(grown)]
                self.cuts[tree] = grown
                for own, node in zip(np.split(v, edge), path[by][np.r_[0, edge]].tolist() if len(by) else []):
                    if len(own) >= FEWEST:
                        lo, hi = cut(own)
                        tight = np.searchsorted(own, hi) - np.searchsorted(own, lo) > TIGHT * len(own)
                        grown[node] = np.inf if tight else (lo, hi)
                at, path, *_ = self._descend(at, path, p, tree, level)
        return self

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, leaf numbers), by row and number; vectors of other lengths have other leaves."""
        p, rows, leaf = self.projected(x), [], []
        for tree in range(self.trees):
            at, path = np.arange(len(x)), np.ones(len(x), np.int64)
            ended = []
            for level in range(self.depth):
                at, path, *stayed = self._descend(at, path, p, tree, level)
                ended.append(stayed)
            for r, node in [*ended, (at, path)]:
                rows.append(r)
                leaf.append(node + ((self.dim * self.trees + tree) << PATH))
        rows, leaf = np.concatenate(rows), np.concatenate(leaf)
        by = np.lexsort((leaf, rows))
        return rows[by], leaf[by]


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _fit(trees: int, depth: int, seed: int):
    def learn(rows: list[dict]) -> dict[int, Forest]:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["vec"]), []).append(r["vec"])
        return {dim: Forest(dim, trees, depth, seed).fit(np.array(v, float)) for dim, v in by.items()}

    return learn


def _leaf_pass(forests: dict[int, Forest], trees: int, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                rows, leaf = (forests.get(dim) or Forest(dim, trees, depth, seed)).leaves(_matrix(own.column(2)))
                ends = np.searchsorted(rows, np.arange(own.num_rows + 1))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))], [*b.schema.names, "leaves"])

    return run


def _shared_before(leaf: int, leaves: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of the rows a shares with each of the rows b a leaf of a smaller number."""

    def flat(rows):
        own = leaves.take(pa.array(rows))
        at, v = np.repeat(np.arange(len(rows)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
        return at[v < leaf], v[v < leaf]

    (ra, va), (rb, vb) = flat(a), flat(b)
    common = np.intersect1d(va, vb)
    if not len(common):
        return np.zeros((len(a), len(b)), bool)
    m = [np.zeros((len(rows), len(common)), np.float32) for rows in (a, b)]
    for at, v, out in ((ra, va, m[0]), (rb, vb, m[1])):
        k = np.minimum(np.searchsorted(common, v), len(common) - 1)
        ok = common[k] == v
        out[at[ok], k[ok]] = 1
    return m[0] @ m[1].T > 0


def _compare(least: float):
    """(x, y, links) of a leaf's block or pair of blocks: each vector linked there, the smallest it is connected with
    there, and how many vectors it is linked with. A pair that shares several leaves counts in the first."""

    def run(key, t):
        leaf, p, q = (k.as_py() for k in key)
        t = t.sort_by("rep").combine_chunks()
        part, ids, n = (t.column(c).to_numpy() for c in ("part", "rep", "n"))
        x, leaves = unit(_matrix(t.column("vec"))), t.column("leaves").combine_chunks()
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        near = x[a] @ x[b].T >= least
        if p == q:
            np.fill_diagonal(near, False)
        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        a, b, near = a[i], b[j], near[np.ix_(i, j)]
        near &= ~_shared_before(leaf, leaves, a, b)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        links[a] += near @ n[b]
        if p != q:
            links[b] += near.T @ n[a]
        moved = near.any()
        while moved:
            was, none = root.copy(), len(ids)
            root[a] = np.minimum(root[a], np.where(near, root[b][None, :], none).min(1))
            root[b] = np.minimum(root[b], np.where(near, root[a][:, None], none).min(0))
            root = root[root]
            moved = (root != was).any()
        some = np.flatnonzero(links)
        return pa.table({"x": ids[some], "y": ids[root[some]], "links": links[some]}, schema=pa.schema([("x", pa.int64()), ("y", pa.int64()), ("links", pa.int64())]))

    return run


def comparable(vector: str) -> Column:
    """Whether a vector has a direction: it isn't null or empty, its components are finite, and one isn't 0."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def linked(reps: DataFrame, least: float = 0.9, block: int = BLOCK, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """(x, y, links) of distinct vectors ``reps`` (rep, n, vec): rows of each linked vector, whose links add up and whose
    edges x - y connect what its links connect.

    Splits are placed by about ``sample`` vectors, chosen by a hash of their ids; every vector then goes down every
    tree, to both sides where it is among the middle tenth or within a margin of the middle; a node most of which that
    margin holds, as a group of near copies, stays whole. A leaf of more than twice ``block`` vectors is cut into
    blocks by a hash of ids and all its pairs of blocks are compared, each in a group of its own, so that no task holds
    a large leaf and no pair is left out."""
    size = reps.count()
    depth = depth_for(size)
    trees = trees_for(depth)
    chosen = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < int(min(1.0, sample / max(size, 1)) * (1 << 30))
    forests = learn_in_task(reps.where(chosen).select("vec"), _fit(trees, depth, seed))
    kinds = dict(reps.dtypes)
    indexed = materialise(reps.select("rep", "n", "vec").mapInArrow(_leaf_pass(forests, trees, depth, seed), f"rep bigint, n bigint, vec {kinds['vec']}, leaves array<bigint>"))
    held = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("held"))
    large = materialise(held.where(F.col("held") > 2 * block).select("leaf", F.ceil(F.col("held") / block).cast("int").alias("parts")))
    sent = indexed.select("rep", "n", "vec", "leaves", F.explode("leaves").alias("leaf")).join(large, "leaf", "left")
    sent = sent.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "rep", "n", "vec", "leaves")
    return sent.groupBy("leaf", "p", "q").applyInArrow(_compare(least), "x bigint, y bigint, links bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept): for each row, how many other rows it is linked with, the smallest id
    reachable by links, and whether that is its own.

    Rows are linked if the cosine of their vectors is ``least`` or more, in double precision, and they share a leaf of
    the forest (see ``linked``) or are equal. Equal vectors are one in the forest, with their number, so copies cost
    nothing there, however many. Null, empty or zero vectors and those with null or non-finite components are linked
    with nothing, as are vectors of different lengths; rows without id aren't either, and have no component. Keys must
    be bigints. A repeated row is linked with its copies. No rows from an empty table."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(comparable(vector) & F.col(key).isNotNull(), F.col(vector)).alias("vec"))
    reps = materialise(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = materialise(linked(reps, least, **how))
    total = found.groupBy("x").agg(F.sum("links").alias("links"))
    root = components(found, "x", "y")
    reps = reps.join(total, reps["rep"] == total["x"], "left").join(root, reps["rep"] == root["node"], "left")
    reps = reps.select(F.col("vec").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(reps, rows["vec"] == reps["of"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
root AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, count(links.b) AS n_links, max(component_id) AS component_id, e.vec_id = max(component_id) AS kept
FROM embeddings e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN root ON root.vec_id = e.vec_id GROUP BY e.vec_id
"""
