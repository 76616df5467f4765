"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from loomgraph.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def table(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in df[names].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    names, rows = table(got)
    wanted, want = table(db.sql(catalog.SQL[name]).df())
    assert names == wanted
    assert [tuple(str(float(x)) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in r) for r in rows] == [
        tuple(str(float(x)) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in r) for r in want
    ]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).columns
