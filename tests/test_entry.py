"""Every registered query answers, and answers what its SQL says."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog
from tools.check import TABLES, canonical, rows_of

# Queries on training data have tests of their own.
NAMES = list(catalog.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"stratum_id", "anchors"} <= set(rows[0].asDict())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
    assert canonical(float("nan")) is None


def test_task_functions_travel_by_value():
    from pyspark import cloudpickle

    assert "tessera" in cloudpickle.list_registry_pickle_by_value()
