"""Queries over catalogues and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.sources import catalog, metadata
from gridlake.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scenes(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 60 + 1).cast("int").alias("utm"), F.lit("N").alias("latitude"), F.col("o_orderstatus").alias("grid"), (F.col("o_custkey") % 233).cast("int").alias("path"), (F.col("o_custkey") % 31).cast("int").alias("row"), F.lit("oli").alias("sensor"), F.col("o_orderdate").cast("date").alias("date"))


@query("SELECT id, path::INT AS path, row::INT AS row FROM (SELECT o_orderkey::VARCHAR AS id, o_custkey % 233 AS path, o_custkey % 31 AS row, o_orderdate::DATE AS d FROM orders) WHERE path < 100 AND path = 7 AND d BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def find_scenes(spark, sf_dir):
    return catalog.found(_scenes(spark, sf_dir), path=7, dates=("1995-01-01", "1997-12-31")).select("id", "path", "row")


@query("SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 60 + 1)::INT AS utm, o_orderstatus AS grid FROM orders")
def add_scenes(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    return catalog.added(s.where("utm < 30"), s).select("id", "utm", "grid")


@query("SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 60 + 1)::INT AS utm FROM orders WHERE o_orderkey % 60 + 1 <> 5")
def remove_scenes(spark, sf_dir):
    s = _scenes(spark, sf_dir)
    return catalog.removed(s, s.where("utm = 5")).select("id", "utm")


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS scene, o_orderstatus AS status FROM orders")
def parse_metadata(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('GROUP = A\n  SCENE = "'), F.col("o_orderkey").cast("string"), F.lit('"\nSTATUS = '), F.col("o_orderstatus"), F.lit("\nEND_GROUP = A\nEND")).alias("text"))
    m = metadata.key_values(F.col("text"))
    return o.select("o_orderkey", m["SCENE"].alias("scene"), m["STATUS"].alias("status"))


@query("SELECT o_orderkey, (o_orderkey % 500)::INT AS samples, 30.0::DOUBLE AS width, (o_custkey * 10)::DOUBLE AS left_ FROM orders")
def parse_envi(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("ENVI\nsamples = "), (F.col("o_orderkey") % 500).cast("string"), F.lit("\nlines = 10\nbands = 2\ndata type = 4\ninterleave = bsq\nmap info = {UTM, 1, 1, "), (F.col("o_custkey") * 10).cast("string"), F.lit(", 500, 30, 30, 17, North}\n"))
    h = metadata.envi_header(text)
    return o.select("o_orderkey", h["samples"].alias("samples"), h["width"].alias("width"), h["left"].alias("left_"))


@query("WITH c AS (SELECT o_custkey % 10 AS i, o_orderkey % 10 AS j, o_totalprice AS v, o_orderdate::DATE AS d FROM orders) SELECT i, j, max(v) AS v FROM c WHERE d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")
def date_composite(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("i"), (F.col("o_orderkey") % 10).alias("j"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").cast("date").alias("date"))
    return catalog.composite(o, "v", ("1995-01-01", "1998-12-31"))
