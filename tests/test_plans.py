"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from tidewake.plans import queries

DATA = os.environ.get("TIDEWAKE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    own = duckdb.connect()
    for name in ("customer", "events"):
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return own


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in row) for row in df[columns].astype(object).values)
    assert text(got) == text(want)
