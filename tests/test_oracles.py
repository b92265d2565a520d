"""Every registered query that has SQL gives the SQL's rows, on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if isinstance(value, datetime.datetime) else value


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    found = contract.queries()[name](spark, str(DATA))
    said = tables.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(found.columns) == sorted(columns)
    want = in_order(columns, said.fetchall())
    assert in_order(found.columns, found.collect()) == want and want


def test_entry(spark):
    assert contract.entry(spark).columns == ["doc_id", "digest"]
