"""Accuracy of maps: confusion matrices, agreement, areas and errors. Cells are counted where they are; the rest is
arithmetic on a table of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.numeric import ratio
from gridlake.operators.regions import TILE, regions


def confusion(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """(predicted, observed, n) of the pairs that occur."""
    return df.groupBy(F.col(predicted).alias("predicted"), F.col(observed).alias("observed")).agg(F.count(F.lit(1)).alias("n"))


def pivoted(matrix: DataFrame, classes: list) -> DataFrame:
    """The matrix with a column for each observed class."""
    return matrix.groupBy("predicted").pivot("observed", classes).agg(F.sum("n")).na.fill(0)


def _marginals(matrix: DataFrame) -> DataFrame:
    """(class, hits, rows, columns): cells right, predicted and observed as the class."""
    hit = F.when(F.col("predicted") == F.col("observed"), F.col("n")).otherwise(0)
    sides = matrix.select(F.explode(F.array(F.struct(F.col("predicted").alias("class"), hit.alias("hits"), F.col("n").alias("rows"), F.lit(0).cast("bigint").alias("columns")), F.struct(F.col("observed").alias("class"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("rows"), F.col("n").alias("columns")))).alias("x")).select("x.*")
    return sides.groupBy("class").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"), F.sum("columns").alias("columns"))


def by_class(matrix: DataFrame, beta: float = 0.5) -> DataFrame:
    """(class, producers, users, f1, f_beta) in percent and shares; 0 where a class was never observed or predicted."""
    m = _marginals(matrix)
    p, u = F.coalesce(ratio(F.col("hits"), F.col("columns")), F.lit(0.0)), F.coalesce(ratio(F.col("hits"), F.col("rows")), F.lit(0.0))
    f = lambda b: F.coalesce(ratio((1 + b * b) * p * u, b * b * u + p), F.lit(0.0))
    return m.select("class", (p * 100).alias("producers"), (u * 100).alias("users"), f(1.0).alias("f1"), f(beta).alias("f_beta"))


def summary(matrix: DataFrame) -> DataFrame:
    """(n, overall, hamming_loss, kappa) of a matrix."""
    m = _marginals(matrix).agg(F.sum("hits").alias("hits"), F.sum("rows").alias("n"), F.sum(F.col("rows").cast("double") * F.col("columns")).alias("cross"))
    o, e = ratio(F.col("hits"), F.col("n")), ratio(F.col("cross"), F.col("n").cast("double") * F.col("n"))
    return m.select("n", (o * 100).alias("overall"), (1 - o).alias("hamming_loss"), ratio(o - e, 1 - e).alias("kappa"))


def kappa(matrix: DataFrame, weights: str | None = None, off_by_one: bool = False) -> DataFrame:
    """Kappa whose disagreements weigh alike, by class distance (``linear``) or its square (``quadratic``), classes
    being numbered in order; with ``off_by_one`` neighbours agree."""
    classes = matrix.select(F.col("predicted").alias("c")).union(matrix.select("observed")).distinct().withColumn("k", F.row_number().over(Window.orderBy("c")))
    # as many rows as there are classes
    row = matrix.groupBy("predicted").agg(F.sum("n").alias("r"))
    col = matrix.groupBy("observed").agg(F.sum("n").alias("c"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    a, b = (classes.select(F.col("c").alias(f"c_{x}"), F.col("k").alias(f"k_{x}")) for x in ("r", "c"))
    every = row.join(a, row["predicted"] == a["c_r"]).withColumn("__", F.lit(1)).join(col.join(b, col["observed"] == b["c_c"]).withColumn("__", F.lit(1)), "__")
    every = every.join(matrix, ["predicted", "observed"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = F.abs(F.col("k_r") - F.col("k_c")).cast("double")
    if off_by_one:
        d = F.greatest(d - 1, F.lit(0.0))
    w = {None: (d > 0).cast("double"), "linear": d, "quadratic": d * d}[weights]
    every = every.withColumn("w", w).withColumn("e", F.col("r").cast("double") * F.col("c") / total)
    return every.agg((1 - ratio(F.sum(F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("e")))).alias("kappa"))


def regression(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """(n, mae, mse, medae, rmse, r2)"""
    e = F.col(predicted) - F.col(observed)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.percentile(F.abs(e), 0.5).alias("medae"), F.var_pop(observed).alias("v"))
    return got.select("n", "mae", "mse", "medae", F.sqrt("mse").alias("rmse"), (1 - ratio(F.col("mse"), F.col("v"))).alias("r2"))


def sample_size(areas: DataFrame, area: str, users: str, error: float) -> DataFrame:
    """Samples for a target standard error of overall accuracy: the square of the weighted deviations over the error."""
    total = F.sum(area).over(Window.partitionBy(F.lit(1)))
    return areas.withColumn("__w", F.col(area) / total).agg(F.round(F.pow(F.sum(F.col("__w") * F.sqrt(F.col(users) * (1 - F.col(users)))) / error, F.lit(2.0))).cast("bigint").alias("samples"))


def adjusted_areas(matrix: DataFrame, areas: DataFrame, z: float = 1.96) -> DataFrame:
    """(class, area, se, margin, producers, users) of stratified estimates; ``areas``: (class, mapped)."""
    a = areas.select(F.col("class").alias("predicted"), F.col("mapped").cast("double").alias("mapped"))
    total = F.sum("mapped").over(Window.partitionBy(F.lit(1)))
    a = a.withColumn("w", F.col("mapped") / total).withColumn("all", total)
    rows = Window.partitionBy("predicted")
    m = matrix.join(a, "predicted").withColumn("row", F.sum("n").over(rows))
    share = m.withColumn("p", F.col("w") * F.col("n") / F.col("row"))
    var = F.pow("w", F.lit(2.0)) * (F.col("n") / F.col("row")) * (1 - F.col("n") / F.col("row")) / F.when(F.col("row") > 1, F.col("row") - 1)
    cols = share.groupBy(F.col("observed").alias("class")).agg(F.sum("p").alias("p"), F.sqrt(F.sum(var)).alias("s"), F.max("all").alias("all"), F.sum(F.when(F.col("predicted") == F.col("observed"), F.col("p"))).alias("hit"))
    users = share.where("predicted = observed").select(F.col("predicted").alias("class"), (F.col("n") / F.col("row")).alias("users"))
    out = cols.join(users, "class", "left")
    return out.select("class", (F.col("p") * F.col("all")).alias("area"), (F.col("s") * F.col("all")).alias("se"), (F.col("s") * F.col("all") * z).alias("margin"), F.coalesce(ratio(F.col("hit"), F.col("p")), F.lit(0.0)).alias("producers"), F.coalesce("users", F.lit(0.0)).alias("users"))


def pairs(matrix: DataFrame) -> DataFrame:
    """(predicted, observed), a row for each counted cell."""
    return matrix.where("n > 0").select("predicted", "observed", F.explode(F.sequence(F.lit(1), F.col("n")))).select("predicted", "observed")


def _eccentricity(i: str, j: str) -> Column:
    """Of the ellipse with a group's second moments: 0 for a circle or one cell, 1 for a line."""
    a, b, c = F.var_pop(i), F.var_pop(j), F.covar_pop(i, j)
    mid, off = (a + b) / 2, F.sqrt(F.pow((a - b) / 2, F.lit(2.0)) + c * c)
    return F.when(mid + off > 1e-12, F.sqrt(F.greatest(1 - (mid - off) / F.when(mid + off > 1e-12, mid + off), F.lit(0.0)))).otherwise(0.0)


def objects(cells: DataFrame, reference: str, predicted: str) -> DataFrame:
    """(reference, predicted, cells, predicted_cells, over, under, fragments, shape, offset, relative) for each reference
    object other than 0: against the predicted object that covers most of it, of several the least.

    ``cells``: (i, j, both labels). ``over`` and ``under`` are the shares of either that the other doesn't cover,
    ``fragments`` the number of predicted objects on it by its cells, ``shape`` the difference of eccentricities,
    ``offset`` the distance of centres in cells, ``relative`` the difference of sizes in percent. Objects that no
    predicted one touches are left out. All are sums by label."""

    def sized(label, p):
        own = cells.where(F.col(label) != 0).groupBy(F.col(label).alias(p))
        return own.agg(F.count(F.lit(1)).alias(f"{p}n"), F.avg("i").alias(f"{p}i"), F.avg("j").alias(f"{p}j"), _eccentricity("i", "j").alias(f"{p}e"))

    both = cells.where((F.col(reference) != 0) & (F.col(predicted) != 0)).groupBy(F.col(reference).alias("r"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    best = both.groupBy("r").agg(F.max(F.struct("n", (-F.col("p")).alias("m"))).alias("x"), F.count(F.lit(1)).alias("parts")).select("r", (-F.col("x.m")).alias("p"), F.col("x.n").alias("n"), "parts")
    j = sized(reference, "r").join(best, "r").join(sized(predicted, "p"), "p")
    frag = F.when(F.col("rn") > 1, (F.col("parts") - 1) / F.when(F.col("rn") > 1, F.col("rn") - 1)).otherwise(0.0)
    return j.select(
        F.col("r").alias("reference"),
        F.col("p").alias("predicted"),
        F.col("rn").alias("cells"),
        F.col("pn").alias("predicted_cells"),
        (1 - F.col("n") / F.col("rn")).alias("over"),
        (1 - F.col("n") / F.col("pn")).alias("under"),
        frag.alias("fragments"),
        F.abs(F.col("re") - F.col("pe")).alias("shape"),
        F.sqrt(F.pow(F.col("ri") - F.col("pi"), F.lit(2.0)) + F.pow(F.col("rj") - F.col("pj"), F.lit(2.0))).alias("offset"),
        ((F.col("pn") - F.col("rn")) * 100.0 / F.col("rn")).alias("relative"),
    )


def objects_of_masks(cells: DataFrame, reference: str, predicted: str, tile: int = TILE) -> DataFrame:
    """``objects`` of two masks: each region of set cells of a mask that touch by their sides is an object, named by the
    number of its first cell and one more. ``cells``: (i, j, both masks); 0 and null cells are in no object."""

    def labelled(mask, name):
        own = cells.where(F.col(mask) != 0).select("i", "j", F.lit(1.0).alias("v"))
        return regions(own, "v", tile).select("i", "j", (F.col("region") + 1).alias(name))

    both = labelled(reference, "r").join(labelled(predicted, "p"), ["i", "j"], "full")
    return objects(both.fillna(0, ["r", "p"]), "r", "p")
