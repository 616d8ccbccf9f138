"""Connected components and positions along chains, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.sources.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``: root is the smallest node it is connected with.

    Each round takes the least root among neighbours and then that root's own, so long ways halve; minima are partial
    before they are sent, and each round's roots are a written table. Edges with a null end don't count; no edges, no
    rows; loops and repeated edges change nothing."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = written(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    at = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")))
    while True:
        near = both.join(at, both["y"] == at["node"]).groupBy("x").agg(F.min("root").alias("least"))
        step = at.join(near, at["node"] == near["x"]).select("node", F.least("root", "least").alias("root"), F.col("root").alias("was"))
        up = step.where("root < node").select(F.col("node").alias("via"), F.col("root").alias("upper"))
        new = written(step.join(up, step["root"] == up["via"], "left").select("node", F.coalesce("upper", "root").alias("root"), "was"))
        at = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return at


def positions(chain: DataFrame, node: str = "id", after: str = "after", ring: str = "ring", size: str | None = None) -> DataFrame:
    """(node, position) along rings, from 0 at each ring's smallest node; ``size`` names the steps that a node takes, else 1.

    ``chain`` has each node once, with the node that follows and its ring's smallest node. Every round adds what lies
    ahead of the node reached so far, twice as many nodes as the round before."""
    left = F.when(F.col(after) != F.col(ring), F.col(after))
    steps = (F.col(size) if size else F.lit(1)).cast("bigint")
    at = written(chain.select(F.col(node).alias("node"), left.alias("next"), steps.alias("steps"), F.col(ring).alias("ring")))
    while at.where("next is not null").limit(1).count():
        on = at.select(F.col("node").alias("via"), F.col("next").alias("further"), F.col("steps").alias("more"))
        at = written(at.join(on, at["next"] == on["via"], "left").select("node", F.col("further").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "ring"))
    size = at.groupBy("ring").agg(F.max("steps").alias("last"))
    return at.join(size, "ring").select("node", (F.col("last") - F.col("steps")).alias("position"))
