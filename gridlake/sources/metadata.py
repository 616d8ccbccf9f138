"""Scene metadata: headers and product files as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_values(text: Column) -> Column:
    """A map of ``KEY = value`` lines; quotes are taken off, lines without ``=`` and group lines left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda l: l.contains("=") & ~F.upper(F.trim(l)).rlike("^(GROUP|END_GROUP)"))
    pairs = F.transform(lines, lambda l: F.struct(F.trim(F.substring_index(l, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(l, r"^[^=]*=", "")), '^"|"$', "").alias("v")))
    last = F.filter(pairs, lambda p: F.lit(True))
    return F.map_from_entries(F.array_distinct(last))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of text files of ``KEY = value`` lines, one row for each file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", key_values(F.col("value")).alias("values"))


def envi_header(text: Column) -> Column:
    """(samples, lines, bands, kind, interleave, left, top, width, height) of an ENVI header; samples are columns."""
    one = lambda key, cast: F.regexp_extract(text, rf"(?im)^\s*{key}\s*=\s*([^\r\n{{]+)", 1).try_cast(cast)
    info = F.split(F.regexp_extract(text, r"(?is)map info\s*=\s*\{([^}]*)\}", 1), ",")
    at = lambda k: F.trim(F.try_element_at(info, F.lit(k))).try_cast("double")
    return F.struct(one("samples", "int").alias("samples"), one("lines", "int").alias("lines"), one("bands", "int").alias("bands"), one("data type", "int").alias("kind"), F.lower(F.trim(one("interleave", "string"))).alias("interleave"), at(4).alias("left"), at(5).alias("top"), at(6).alias("width"), at(7).alias("height"))


#: ENVI data types.
ENVI_KINDS = {1: "u1", 2: "<i2", 3: "<i4", 4: "<f4", 5: "<f8", 12: "<u2", 13: "<u4", 14: "<i8", 15: "<u8"}


def read_raw(spark: SparkSession, path: str, rows: int, columns: int, bands: int, kind: int, interleave: str = "bsq") -> DataFrame:
    """(path, i, j, bands) of raw grids beside an ENVI header: one row for each cell, read by Spark's own reader."""
    import numpy as np
    import pandas as pd

    order = {"bsq": (bands, rows, columns), "bil": (rows, bands, columns), "bip": (rows, columns, bands)}[interleave]
    axes = {"bsq": (1, 2, 0), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content):
                a = np.frombuffer(content, ENVI_KINDS[kind]).reshape(order).transpose(axes).astype(float)
                for i in range(rows):
                    yield pd.DataFrame({"path": p, "i": i, "j": range(columns), "bands": list(a[i])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i bigint, j bigint, bands array<double>")


def product_values(xml: Column, paths: dict[str, str]) -> Column:
    """A struct of XPath values of a product file."""
    return F.struct(*(F.xpath_string(xml, F.lit(p)).alias(n) for n, p in paths.items()))
