"""Connected components of a graph that only executors see."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import give_back, materialise


HEAVY = 50_000  # edges of a node from which its edges are dealt out by more than the node
IN_TASK = 1 << 19  # edges that a task holds at once


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the edges x - y."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j, root = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while len(i):
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _forest_pass(most: int):
    """Edges (x, y) of each node and its smallest, of some ``most`` edges at a time; they connect what those connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            x, y = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in forest(x, y)], ["x", "y"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in (0, 1)])
            size += b.num_rows
            if size >= most:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        give_back()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", in_task: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    With ``in_task``, nodes are bigints, each task first replaces its edges by a forest, and if the forests have no more
    than so many edges together, one task ends the work; each round would cost the driver several jobs. More edges, or
    all without ``in_task``, go through rounds.

    Each round takes the least label among neighbours, then the label of that label, so long paths halve. Sums and
    minima are partial before shuffles; a node of very many edges is salted: its edges are dealt out and its label is
    sent to each part. Such nodes are at most one in ``HEAVY`` edges, so their table may be broadcast. Each round's
    labels are a table in the shared folder. No edges: no rows. Self-loops and repeated edges change nothing; edges
    with a null end are left out."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    if in_task:
        e = materialise(e.mapInArrow(_forest_pass(in_task), "x bigint, y bigint"))
        if e.count() <= in_task:
            whole = e.repartition(1).mapInArrow(_forest_pass(in_task + 1), "x bigint, y bigint")
            return materialise(whole.select(F.col("x").alias("node"), F.col("y").alias("root")))
    sym = materialise(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialise(sym.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    heavy = sym.groupBy("y").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > HEAVY)
    heavy = materialise(heavy.select(F.col("y").alias("hub"), F.ceil(F.col("edges") / HEAVY).cast("int").alias("parts")))
    if salted := heavy.limit(1).count():
        heavy = F.broadcast(heavy)
        sym = sym.join(heavy, sym["y"] == heavy["hub"], "left").select("x", "y", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    while True:
        if salted:
            dealt = labels.join(heavy, labels["node"] == heavy["hub"], "left").select("node", "root", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            near = sym.join(dealt, (sym["y"] == dealt["node"]) & (sym["salt"] == dealt["part"]))
        else:
            near = sym.join(labels, sym["y"] == labels["node"])
        near = near.groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        # only roots that have found a smaller one are sent, so few that adaptive execution broadcasts or splits the join
        up = step.select(F.col("node").alias("up"), F.col("root").alias("upper")).where("upper < up")
        new = materialise(step.join(up, step["root"] == up["up"], "left").select("node", F.coalesce("upper", "root").alias("root"), "was"))
        labels = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return labels
