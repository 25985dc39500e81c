import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from clausewright.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sql, name):
    ours, theirs = registry.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
