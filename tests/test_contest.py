"""Edge rows of the contest and what-if operators."""

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import contest as C
from tallyspark.operators import relational as R
from tallyspark.operators import whatif as Q

ROWS = "period int, region string, contest string, option string, votes double"


def test_ties_single_options_and_zero_votes(spark):
    rows = spark.createDataFrame([(1, "r", "tie", "b", 5.0), (1, "r", "tie", "a", 5.0), (1, "r", "one", "a", 3.0), (1, "r", "none", "a", 0.0), (1, "r", "none", "b", 0.0), (1, "r", "x", None, 1.0)], ROWS)
    out = {(r.contest, r.option): r for r in C.build_results(rows).collect()}
    assert out["tie", "a"].winner and not out["tie", "b"].winner and out["tie", "a"].margin_votes == 0
    assert out["one", "a"].margin_votes is None and out["none", "a"].vote_share is None and len(out) == 5
    f = {r.contest: r for r in C.contest_features(C.build_results(rows)).collect()}
    assert f["one"].top2_margin_pct is None and f["none"].effective_options is None


def test_periods_that_do_not_match(spark):
    prev = C.build_results(spark.createDataFrame([(1, "r", "gone", "a", 1.0), (1, "r", "both", "a", 1.0)], ROWS))
    curr = C.build_results(spark.createDataFrame([(2, "r", "new", "a", 1.0), (2, "r", "both", "b", 1.0)], ROWS))
    assert {(r.contest, r.reason) for r in C.unmatched(prev, curr).collect()} == {("gone", "missing in current"), ("new", "missing in previous")}
    swings = {(r.contest, r.option): r.swing for r in C.option_swings(prev, curr).where("contest = 'both'").collect()}
    assert swings == {("both", "a"): -100.0, ("both", "b"): 100.0}


def test_zero_sum_keeps_totals_and_floors(spark):
    rows = C.build_results(spark.createDataFrame([(1, "r", "c", "a", 60.0), (1, "r", "c", "b", 40.0)], ROWS))
    out = {r.option: r.sim_share for r in Q.apply_deltas_zero_sum(rows, spark.createDataFrame([("r", "b", -90.0)], "region string, option string, swing double")).collect()}
    assert out == {"a": 100.0, "b": 0.0}


def test_ensemble_does_not_depend_on_partitions(spark):
    base = spark.createDataFrame([("c", "r", "x", 50.0), ("c", "r", "y", 50.0), ("d", "r", "x", 10.0)], "contest string, region string, group string, share double")
    first = sorted(Q.ensemble(base, 20, independent=True).collect())
    assert first == sorted(Q.ensemble(base.repartition(7), 20, independent=True).collect())


def test_ensemble_summary_counts_draws_without_seats(spark):
    """x wins a seat in 1 of 5 draws, z in none, y has both seats or one; v (2 seats in draw 5) forms no alliance."""
    won = [(1, "c", "y"), (1, "d", "y"), (2, "c", "y"), (2, "d", "y"), (3, "c", "y"), (3, "d", "x"), (4, "c", "y"), (4, "d", "y"), (5, "c", "v"), (5, "d", "v")]
    drawn = spark.createDataFrame(won, "draw int, contest string, winner string")
    groups = spark.createDataFrame([("v",), ("x",), ("y",), ("z",)], "group string")
    seats = Q.ensemble_seats(drawn, groups, 5)
    assert sorted(map(tuple, seats.where("group in ('x', 'z')").collect())) == sorted([(d, "x", int(d == 3)) for d in range(1, 6)] + [(d, "z", 0) for d in range(1, 6)])
    out = {r.group: r for r in Q.ensemble_summary(seats, 2, hung=True, rest=["v"]).collect()}
    assert {g: (r.p10, r.p50, r.p90, r.plurality, r.majority) for g, r in out.items()} == {"v": (0, 0, 0, 0.2, 0.2), "x": (0, 0, 0, 0.2, 0.0), "y": (0, 2, 2, 0.6, 0.6), "z": (0, 0, 0, 0.0, 0.0)}
    assert {r.hung for r in out.values()} == {0.4} and {r.hung for r in Q.ensemble_summary(seats, 2, hung=True).collect()} == {0.2}


def test_percent_cells_and_labels(spark):
    df = spark.createDataFrame([("12%",), ("0.4",), ("-",), ("n=500",), ("45 (12)",), ("120",), (None,)], "c string")
    assert [r.x for r in df.select(S.parse_percent(F.col("c")).alias("x")).collect()] == [12.0, 40.0, None, None, None, None, None]
    assert [r.x for r in df.select(S.parse_percent(F.col("c"), loose=True).alias("x")).collect()][3:5] == [None, 45.0]
    names = spark.createDataFrame([("Nagar (SC)",), ("A & B",), ("X - Y",), (None,)], "c string")
    assert [r.x for r in names.select(S.norm_key(F.col("c")).alias("x")).collect()] == ["NAGAR", "A AND B", "X Y", None]


def test_joins_make_no_cartesian_plan(spark):
    left = spark.range(100).select((F.col("id") % 5).alias("block"), F.concat(F.lit("name"), "id").alias("name"))
    plan = R.fuzzy_block_match(left, left, "block", 0.9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
