"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# the pipeline has no SQL
NAMES = [n for n in QUERIES if n in SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x


def order(row):
    """Rows in order of what is not a number, then of the numbers."""
    return [str(x) for x in row if not isinstance(x, float)], [f"{x:+.3e}" for x in row if isinstance(x, float)], [x for x in row if isinstance(x, float)]


def close(x, y):
    """Sums in another order differ in the last digits."""
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(close, x, y))
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else str(x) == str(y)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    want = sorted(([plain(r[columns.index(c)]) for c in names] for r in cursor.fetchall()), key=order)
    found = sorted(([plain(r[c]) for c in names] for r in got), key=order)
    assert len(found) == len(want)
    assert [(x, y) for x, y in zip(found, want) if not all(map(close, x, y))] == []


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
