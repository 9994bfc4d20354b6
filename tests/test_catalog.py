"""Every query with a SQL twin against DuckDB, on the small tables where they are there."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from barloom.jobs import catalog

TABLES = "/root/testdata/sf0.01"
_HEAVY = {"ewm_features", "lines_rolling", "bars_lines"}

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df, cols):
    return sorted(tuple("" if pd.isna(v) else str(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - _HEAVY))
def test_query_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, TABLES).toPandas()
    want = db.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) > 0
    assert rows(got, cols) == rows(want, cols)
