"""Every query with SQL agrees with the independent engine on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pandas as pd
import pytest

from prufspark.plans.oracle import oracle_sql
from prufspark.plans.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(df: pd.DataFrame) -> list[tuple]:
    def f(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9))
        if isinstance(v, (pd.Timestamp, datetime.date)):
            return pd.Timestamp(v).tz_localize(None).isoformat()
        return str(v)

    return sorted(tuple(map(f, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, FOLDER).toPandas()
    if name in oracle_sql():
        want = con.execute(oracle_sql()[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
