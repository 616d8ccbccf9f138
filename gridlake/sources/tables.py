"""Grids and layers read out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "midir", "farir", "rededge", "cblue", "yellow", "rededge3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, value, class): 100 columns, cells in the order of event ids."""
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 100).alias("i"), (F.col("event_id") % 100).alias("j"), "value", F.array_position(kinds, F.col("event_type")).cast("int").alias("class"))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, price, class)"""
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 100).alias("i"), (F.col("o_orderkey") % 100).alias("j"), F.col("o_totalprice").alias("price"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class"))


def reflectances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bands, and the first ten bands by name), moved into 0 to 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("bands"))
    return e.select("vec_id", "label", "bands", *(F.element_at("bands", k).alias(b) for k, b in enumerate(BANDS, 1)))
