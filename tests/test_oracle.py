"""Every general query against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import tarnline.plans.analytics  # noqa: F401
import tarnline.plans.relational  # noqa: F401
from tarnline.plans.registry import ORACLE_SQL, QUERIES
from tarnline.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    ours = ordered(QUERIES[name](spark, DATA).toPandas())
    theirs = ordered(db.execute(ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=1e-9)
    assert len(ours) > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
