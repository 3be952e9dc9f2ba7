"""Every query of the engine's own operators against its SQL twin in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from podium import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(values, order):
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    a = rows([tuple(r) for r in df.collect()], [df.columns.index(c) for c in columns])
    b = rows(found.fetchall(), [found.columns.index(c) for c in columns])
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
