"""The summary of the ensemble where groups win no seats, against its SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


def tables(spark, folder, votes):
    """votes: (size, brand, quantity) in the second period."""
    day = datetime.datetime(2000, 1, 1)
    brands = sorted({(s, b) for s, b, _ in votes})
    key = {x: i for i, x in enumerate(brands)}
    made = {
        "nation": ([(0, "N")], "n_nationkey int, n_name string"),
        "supplier": ([(0, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(i, f"Brand#{b}", s) for (s, b), i in key.items()], "p_partkey long, p_brand string, p_size int"),
        "lineitem": ([(key[s, b], 0, float(q), day) for s, b, q in votes], "l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize(
    "votes, groups",
    [
        ([(1, 1, 60), (1, 2, 30), (1, 3, 10), (2, 1, 90), (2, 3, 10)], {"G1"}),  # others never win
        ([(1, 1, 60), (1, 2, 40), (2, 2, 90), (2, 3, 10), (3, 3, 50), (3, 6, 50)], {"G0", "G1", "G2"}),
        ([(1, 1, 60), (1, 2, 40), (2, 2, 90)], {"G1", "G2"}),
    ],
)
def test_summary_is_that_of_its_sql(spark, tmp_path, votes, groups):
    con = tables(spark, str(tmp_path), votes)
    df = entry.queries()["f10_ensemble_summary"](spark, str(tmp_path))
    got = sorted(tuple(r[c] for c in ("group", "plurality", "majority", "p10", "p50", "p90")) for r in df.collect())
    assert got == con.execute(f'SELECT "group", plurality, majority, p10, p50, p90 FROM ({entry.oracle_sql()["f10_ensemble_summary"]}) ORDER BY 1').fetchall()
    assert {r[0] for r in got} == groups
    if len(groups) == 1:
        full = entry.queries()["f10_ensemble_summary_full"](spark, str(tmp_path))
        assert {r["group"] for r in full.collect()} == {"G0", "G1", "G2"}
