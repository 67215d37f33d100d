"""Every registered query of the library against its SQL in an independent engine."""

import math
import os

import duckdb
import pandas as pd
import pytest

from textgraph import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, DIR)
    found = df.toPandas()
    if name in catalogue.SQL:
        assert rows(found) == rows(duck.sql(catalogue.SQL[name]).df())
    else:
        assert len(found)
