"""Every query runs on the smallest tables; those with SQL give its rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import canonical, dicts

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    rows = dicts(df)
    if name in SQL:
        want = tables.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows) == canonical(dict(zip(names, r)) for r in want.fetchall())


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_core_does_not_import_the_optional_package():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "sedgework"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "sedgework.llm" not in path.read_text(), path


def test_entry(spark):
    assert entry.entry(spark).columns
