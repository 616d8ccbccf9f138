"""Every query of the library against the same rows in SQL."""

import os
from collections import Counter

import duckdb
import pytest

from gridlake.plans import blocks, catalogue, learning, queries

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES | catalogue.QUERIES | learning.QUERIES | blocks.QUERIES
ORACLE = queries.ORACLE | catalogue.ORACLE | learning.ORACLE | blocks.ORACLE


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return (round(v, 4) + 0.0 if v == v else "nan") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert got
    if name in ORACLE:
        rel = sql.execute(ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
        assert Counter(got) == Counter(want)
