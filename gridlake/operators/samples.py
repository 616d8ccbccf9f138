"""Sample tables: reading and writing them, cleaning, and splitting them for training and testing in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.operators import sampling
from gridlake.operators.neighbours import propagated


def read_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of sample files with a header line, whatever ends their lines and with or without a byte order mark.

    Types are taken from the values unless a schema is given."""
    r = spark.read.option("header", True)
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Files of comma-separated values with a header line, one for each partition."""
    samples.write.mode(mode).option("header", True).csv(path)


def without_classes(samples: DataFrame, label: str, classes: list) -> DataFrame:
    """Rows of other classes; rows without a class stay."""
    return samples.where(~F.coalesce(F.col(label).isin(classes), F.lit(False))) if classes else samples


def with_observations(samples: DataFrame, clear: str, least: int) -> DataFrame:
    """Rows of ``least`` clear observations or more."""
    return samples.where(F.col(clear) >= least)


def without_values(samples: DataFrame, feature: str, under: float) -> DataFrame:
    """Rows whose feature isn't less than ``under``; rows without a value stay."""
    return samples.where(~F.coalesce(F.col(feature) < under, F.lit(False)))


def recoded(samples: DataFrame, label: str, rules: dict) -> DataFrame:
    """Classes mapped all at once; those without a rule stay."""
    out = F.col(label)
    for a, b in rules.items():
        out = F.when(F.col(label) == a, F.lit(b)).otherwise(out)
    return samples.withColumn(label, out)


def one_against_all(samples: DataFrame, label: str, classes: list) -> DataFrame:
    """1 for the classes of the list, 0 for all others."""
    return samples.withColumn(label, F.coalesce(F.col(label).isin(classes), F.lit(False)).cast("int"))


def standardised(samples: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, by their deviation where that isn't 0."""
    got = samples.agg(*(f(c).alias(f"{n}_{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return samples.withColumns({c: (F.col(c) - (got[f"m_{k}"] or 0.0)) / (got[f"s_{k}"] or 1.0) for k, c in enumerate(features)})


def compared(base: DataFrame, later: DataFrame, key: str, features: list[str], label: str = "response", distance: float = 500.0, share: float = 0.75, weight: str | None = None, replaced: float = 2.0, spread: bool = False, add: bool = False, **how) -> DataFrame:
    """Rows of ``later`` that have changed little since ``base``: those of which ``share`` of the features, rounded down,
    are less than ``distance`` away when squared. Rows are matched by their key; those without a match go.

    With ``spread`` the others stay, with the label that spreads to them over features (see ``neighbours.propagated``,
    to which ``how`` goes). ``weight`` is a column of ``base``; its rows of weight 1 give ``replaced``, others their own.
    ``add`` puts the rows of ``base`` before, with the columns of both."""
    old = base.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__old{k}") for k, c in enumerate(features)), *([F.col(weight).alias("__weight")] if weight else []))
    out = later.drop(weight) if weight else later
    columns = out.columns
    out = out.join(old, F.col(key) == F.col("__key"))
    near = sum((F.coalesce(F.pow(F.col(c) - F.col(f"__old{k}"), F.lit(2.0)) < distance, F.lit(False)).cast("int") for k, c in enumerate(features)), F.lit(0))
    out = out.withColumn("__near", near >= int(share * len(features)))
    kept = [F.col(c) for c in columns] + ([F.when(F.col("__weight") == 1, F.lit(float(replaced))).otherwise(F.col("__weight")).alias(weight)] if weight else [])
    if spread:
        todo = out.withColumn(label, F.when(F.col("__near"), F.col(label)).otherwise(F.lit(-1)))
        found = propagated(todo, key, label, features, method="spread", **how).select(F.col(key).alias("__of"), F.col(label).alias("__found"))
        out = out.join(found, F.col(key) == F.col("__of")).withColumn(label, F.col("__found").cast(dict(later.dtypes)[label]))
    else:
        out = out.where("__near")
    out = out.select(*kept)
    return base.select(*out.columns).unionByName(out) if add else out


@dataclass
class Split:
    """Rows for training and for testing, and what their columns are."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    label: str
    weight: str | None = None
    key: str | None = None
    classes: list = field(default_factory=list)


def split_samples(
    samples: DataFrame, label: str = "response", x: str = "X", y: str = "Y", key: str | None = None, share: float | None = None, share_each: float | None = 0.5, counts: dict | None = None, recode: dict | None = None,
    against_all: list | None = None, remove: list | None = None, under: dict[str, float] | None = None, ignore: list[int] | None = None, use_xy: bool = False, weight: str | None = None, clear: str | None = None,
    least: int = 10, scale: bool = False, stratified: bool = False, spacing: float = 1000.0, limit_test: int | None = None, seed: int = 1,
) -> Split:
    """Cleans samples and draws training rows from them: exact numbers, the same whatever the partitions.

    Features are all columns but the coordinates, the label, the key, the weight and the clear count; ``ignore`` leaves
    out some by their number from 1, ``use_xy`` adds the coordinates after the others. Then classes go (``remove``),
    rows of too few clear observations, and rows with a feature below its bound (``under``); then classes are mapped
    (``recode``) or made 1 and 0 (``against_all``). Training takes of each class a share or, by ``counts``, a number
    (1 or more) or a share (below 1) for each class named and nothing of others; or with ``share`` a part of all rows
    whatever their class, which overrides ``share_each``. ``stratified`` draws in turns from squares of ``spacing``.
    ``limit_test`` keeps so many test rows. Without ``key``, rows are told apart by all their values."""
    own = {label, x, y, key, weight, clear}
    features = [c for n, c in enumerate((c for c in samples.columns if c not in own), 1) if n not in (ignore or [])] + ([x, y] if use_xy else [])
    df = without_classes(samples, label, remove or [])
    if clear:
        df = with_observations(df, clear, least)
    for c, v in (under or {}).items():
        df = without_values(df, c, v)
    if recode:
        df = recoded(df, label, recode)
    if against_all:
        df = one_against_all(df, label, against_all)
    if scale:
        df = standardised(df, features)
    by = key or "__key"
    if not key:
        df = df.withColumn(by, F.md5(F.to_json(F.struct(*df.columns)).cast("binary")))
    rank = None
    if stratified:
        square = sampling.strata(F.col(x), F.col(y), 0.0, 0.0, spacing)
        turn = F.row_number().over(Window.partitionBy(label, square).orderBy(sampling.order(by, seed), by))
        df = df.withColumn("__turn", F.least(turn, F.lit((1 << 18) - 1)))
        rank = F.shiftleft(F.col("__turn").cast("bigint"), 44).bitwiseOR(F.shiftright(sampling.order(by, seed), 16))
    if share is not None:
        df = sampling.split(df, by, None, share, seed=seed, rank=rank)
    elif counts:
        sizes = {r[0]: r[1] for r in df.where(F.col(label).isin(list(counts))).groupBy(label).count().collect()}
        df = sampling.split(df, by, label, count={c: int(sizes.get(c, 0) * n) if n < 1 else int(n) for c, n in counts.items()}, seed=seed, rank=rank)
    else:
        df = sampling.split(df, by, label, share_each, seed=seed, rank=rank)
    train, test = (df.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    if limit_test is not None:
        test = sampling.split(test, by, None, count=limit_test, seed=seed).where("part = 'train'").drop("part")
    classes = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    return Split(train.drop("__key", "__turn"), test.drop("__key", "__turn"), features, label, weight, key, classes)
