"""The driver's entry points, and each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = tables.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    assert _rows(df.collect(), df.columns, order) == _rows(cursor.fetchall(), names, order)
