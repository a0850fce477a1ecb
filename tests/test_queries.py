"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from weftline.plans import catalog, views

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLE_SQL)


def normal(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(repr([cell(x) for x in row]) for row in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in views.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.QUERIES) >= 90
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
