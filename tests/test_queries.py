"""Every query against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from millrace.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, np.bool_ | bool):
        return bool(v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, small, name):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
