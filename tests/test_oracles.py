"""Every query with SQL gives DuckDB's rows at the smallest size; the others give rows of a stable schema."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | Decimal):
        return f"{float(v):.6g}" if abs(v) < 2**53 and not isinstance(v, int) else f"{v}" if isinstance(v, int) and abs(v) >= 10**6 else f"{float(v):.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n != "pipeline"))
def test_same_rows_as_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"game_episodes", "walk_sample"}))
def test_runs(spark, name):
    found = entry.queries()[name](spark, SF)
    assert found.columns and found.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
