"""The driver's contract: queries run, and equal their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from loam import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and set(queries.queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) if name not in queries.ORACLES else None
    if got is not None:
        assert got and all(r[sorted(df.columns).index("missed")] == 0 for r in got)
        return
    want = sql.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_nothing_else_imports_the_text_operators():
    root = os.path.dirname(contract.__file__)
    for folder, _, names in os.walk(os.path.join(root, "loam")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "loam.llm" not in open(os.path.join(folder, n)).read()
