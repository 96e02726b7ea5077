"""Every query of the catalog against its SQL on DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from millwright.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    """Rows with columns by name; numbers to six places."""
    columns = sorted(frame.columns)
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return columns, Counter(tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def test_without_sql(spark):
    for name in catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert sum(got[1].values()) > 0
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
