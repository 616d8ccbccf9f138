"""Small tables with the cases that every operator defines a result for."""

import os

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, id string, hits string"


def docs(spark, rows):
    """A documents table from (doc_id, text) or fuller rows, with extra columns whose names clash with internal ones."""
    full = [(*r, *("en", "s0", None)[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(i, t, a, b, n, "x", "y", "z") for i, t, a, b, n in full], DOCS)


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def table(spark, name):
    return spark.read.parquet(os.path.join(SF, f"{name}.parquet"))
