"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as driver

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    answer = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted((tuple(map(plain, row)) for row in answer.fetchall()), key=repr)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert found == expected


def test_every_query_has_sql():
    assert set(driver.QUERIES) == set(driver.ORACLE)
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
