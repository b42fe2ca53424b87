"""Nearest neighbours of sides that lie far apart, of crowded places, and of values that are no numbers."""

import math
import random
import statistics

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.operators import relational, spatial, worklists


def joined_rows(plan):
    """Rows that each join of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return joined_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined_rows(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
    return own + [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]


def test_sides_far_apart_meet_in_few_rows(spark):
    """Queries far outside of the rows: before, each met all rows of its block."""
    draw = random.Random(3)
    rows = [(1, i, [draw.uniform(0, 11_000), draw.gauss(30_000, 700)]) for i in range(3000)]
    queries = [(1, i, [draw.uniform(0, 11_000), draw.gauss(2_500, 900)]) for i in range(3000)]
    found = spatial.nearest(
        spark.createDataFrame(queries, "block int, a long, point array<double>"), spark.createDataFrame(rows, "block int, b long, point array<double>"),
        ["block"], 2, 1, spatial.mean_difference, spread=2,
    )
    got = {r.a: (r.b, r.distance) for r in found.collect()}
    far = lambda x, y: (abs(x[0] - y[0]) + abs(x[1] - y[1])) / 2
    assert got == {a: min(((far(x, y), b) for _, b, y in rows))[::-1] for _, a, x in queries}
    made = joined_rows(found._jdf.queryExecution().executedPlan())
    assert made and max(made) < 0.05 * 3000 * 3000


def test_mutual_nearest_of_crowded_places(spark):
    """Thousands of rows at one point and along one line, a block on one side alone, null blocks, and values that are no numbers."""
    draw = random.Random(5)
    spot = lambda: draw.choice([(1.0, 1.0), (draw.choice([0.0, 1.0, 2.0]), 1.0), (draw.gauss(0, 9), 1.0), (draw.gauss(0, 9), draw.gauss(90, 9))])
    left = [(draw.choice([1, 1, 1, 2]), i, *spot()) for i in range(1200)] + [(None, 9001, 1.0, 1.0), (3, 9002, 1.0, 1.0), (1, 9003, math.nan, 1.0)]
    right = [(draw.choice([1, 1, 2, 2]), f"n{i:04}", *spot()) for i in range(700)] + [(None, "x", 1.0, 1.0), (4, "y", 1.0, 1.0), (2, "z", math.nan, math.nan), (2, "n", 1.5, math.inf)]
    cost = lambda x, y: math.inf if math.isnan(d := (abs(x[2] - y[2]) + abs(x[3] - y[3])) / 2) else d
    of_code = {x[1]: min((cost(x, y), y[1]) for y in right if x[0] == y[0]) for x in left if any(x[0] == y[0] is not None for y in right)}
    of_name = {y[1]: min((cost(x, y), x[1]) for x in left if x[0] == y[0]) for y in right if any(x[0] == y[0] is not None for x in left)}
    want = {(c, n) for c, (_, n) in of_code.items() if of_name[n][1] == c}
    frame = lambda rows, key: spark.createDataFrame(rows, f"block int, {key}, x double, y double")
    got = worklists.mutual_nearest(frame(left, "code int"), frame(right, "name string"), "block", ["x", "y"])
    assert {(r.code, r.name) for r in got.collect()} == want and len(want) > 50
    assert worklists.mutual_nearest(frame(left, "code int").withColumn("x", F.lit(None).cast("double")), frame(right, "name string"), "block", ["x", "y"]).isEmpty()


def test_neighbours_at_equal_distances_are_those_of_the_sql(spark):
    """Sizes and prices form a lattice, so many distances differ by rounding alone: 17 of 1,000 rows differed before."""
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    got = {(r.a, r.b): r.distance for r in entry.queries()["t4_nearest_neighbours"](spark, folder).collect()}
    assert got == {(a, b): d for a, b, d in con.execute(entry.oracle_sql()["t4_nearest_neighbours"]).fetchall()}


def test_running_moments(spark):
    """Digits of one pass in one partition; several partitions, empty ones too, are merged."""
    draw = random.Random(2)
    xs = [(draw.gauss(1e6, 1), draw.randint(1, 9)) for _ in range(5000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE, y INT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", xs[:500])
    frame = lambda rows, n: spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "x double, y int")
    one = relational.running_moments(frame(xs[:500], 1), ["x", "y"])
    assert (*one["x"], *one["y"]) == con.execute("SELECT avg(x), stddev_pop(x), avg(y), stddev_pop(y) FROM t").fetchone()
    for rows, n in ((xs, 7), (xs[:3], 5)):
        found = relational.running_moments(frame(rows, n), ["x", "y"])
        for i, f in enumerate("xy"):
            column = [r[i] for r in rows]
            assert math.isclose(found[f][0], statistics.fmean(column), rel_tol=1e-12) and math.isclose(found[f][1], statistics.pstdev(column), rel_tol=1e-9)
    assert relational.running_moments(frame([], 2), ["x"]) == {"x": (0.0, 0.0)}
