"""The scene catalogue: metadata rows and tiles in partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["id", "utm", "latitude", "grid"]
FIELDS = "id string, utm int, latitude string, grid string, path int, row int, sensor string, date date, rows int, columns int, left double, top double, width double, height double, clear double"


def added(catalogue: DataFrame, scenes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``catalogue`` with those of ``scenes`` whose keys it doesn't hold; of equal new ones one."""
    new = scenes.dropDuplicates(keys).join(catalogue.select(*keys), keys, "left_anti")
    return catalogue.unionByName(new, allowMissingColumns=True)


def found(catalogue: DataFrame, path: int | None = None, row: int | None = None, sensor: str | None = None, dates: tuple[str, str] | None = None, **parts: str) -> DataFrame:
    """Scenes by path, row, sensor, dates (both ends count) and parts of text fields: predicates that reach the scan."""
    out = catalogue
    if path is not None:
        out = out.where(F.col("path") == path)
    if row is not None:
        out = out.where(F.col("row") == row)
    if sensor is not None:
        out = out.where(F.col("sensor") == sensor)
    if dates:
        out = out.where(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    for c, text in parts.items():
        out = out.where(F.col(c).contains(text))
    return out


def removed(catalogue: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return catalogue.join(ids.select(key).distinct(), key, "left_anti")


def save(tiles: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Tiles in folders by UTM zone, latitude band, grid and sensor; only the folders written are replaced."""
    tiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ["utm", "latitude", "grid", "sensor"])).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def composite(tiles: DataFrame, value: str, dates: tuple[str, str]) -> DataFrame:
    """(i, j, value): the largest value of each cell between two dates."""
    return tiles.where(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date"))).groupBy("i", "j").agg(F.max(value).alias(value))
