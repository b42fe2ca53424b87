"""Base shares of a scenario and both periods in one pass, over odd rows."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import contest as C
from tallyspark.operators import whatif as Q


def test_simulated_base(spark):
    results = spark.createDataFrame([("r", "full", "A", 60.0, 1), ("r", "full", "B", 40.0, 2), ("q", "away", "A", 100.0, 1)], "region string, contest string, option string, vote_share double, rank long")
    contests = spark.createDataFrame(
        [("full", "r", "A", "high", None, None), ("c1", "r", "A", "medium", 50.0, 20.0), ("c2", "r", "Z", None, 30.0, None), ("c3", "r", None, "high", 70.0, 60.0), ("bad", "r", "A", "low", 1.0, 1.0), ("away", "q", "A", "high", 1.0, 1.0)],
        "contest string, region string, winner string, quality string, a double, b double",
    )
    found = Q.simulated_base(results, contests, {"A": "a", "B": "b"}, region="r", low_quality=False)
    rows = {(r.contest, r.option): (r.vote_share, r["rank"], r.completeness) for r in found.collect()}
    assert rows == {
        ("full", "A"): (60.0, 1, "full"), ("full", "B"): (40.0, 2, "full"), ("c1", "A"): (50.0, 1, "limited"), ("c1", "B"): (20.0, None, "limited"), ("c1", "OTHERS"): (30.0, None, "limited"),
        ("c2", "A"): (30.0, None, "limited"), ("c2", "B"): (0.0, None, "limited"), ("c2", "Z"): (70.0, 1, "limited"), ("c3", "A"): (70.0, None, "limited"), ("c3", "B"): (60.0, None, "limited"), ("c3", "OTHERS"): (0.0, 1, "limited"),
    }
    everything = Q.simulated_base(results, contests, {"A": "a", "B": "b"})
    assert {r.contest for r in everything.collect()} == {"full", "c1", "c2", "c3", "bad", "away"}
    assert Q.simulated_base(results.limit(0), contests.limit(0), {"A": "a"}).isEmpty()


def test_contest_pairs_are_both_periods_joined(spark):
    """Against ranking each period and joining them: ties, null votes, sums of 0, contests and options of one period."""
    draw = random.Random(7)
    rows = [(p, "r" if c % 2 else None, f"c{c}", o, draw.choice([0.0, 5.0, 5.0, 9.0, None]) if c else 0.0) for p in (1, 2) for c in range(12) for o in "abcd" if draw.random() < 0.7 and not (p == 1 and c == 3) and not (p == 2 and c == 4)]
    df = spark.createDataFrame(rows + [(1, "r", None, "a", 1.0), (2, "r", "c9", None, 1.0), (7, "r", "c9", "a", 99.0)], "period int, region string, contest string, option string, votes double")
    ranked = C.build_results(df)
    prev, curr = ranked.where("period = 1").drop("period"), ranked.where("period = 2").drop("period")
    pairs = C.contest_pairs(df, options=["a"])
    near = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
    rows_of = lambda d: sorted((near(r) for r in d.collect()), key=str)
    for side, other in (("prev", prev), ("curr", curr)):
        want = C.contest_features(other, ["contest"])
        assert rows_of(C.features_of(pairs, side).select(want.columns)) == rows_of(want)
    compared = C.compare_winners(C.contest_features(prev, ["contest"]), C.contest_features(curr, ["contest"]))
    swings = C.option_swings(prev, curr)
    want = C.volatility(compared, C.contest_features(curr, ["contest"]), swings)
    assert rows_of(C.volatility_of(pairs).select(want.columns)) == rows_of(want)
    want = C.master(compared, C.contest_features(prev, ["contest"]), C.contest_features(curr, ["contest"]), swings, ["a"])
    assert rows_of(C.master_of(pairs, ["a"]).select(want.columns)) == rows_of(want)
    assert C.contest_pairs(df.limit(0)).isEmpty()
    plan = C.volatility_of(C.contest_pairs(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.lit(1).alias("period"), F.col("o_orderstatus").alias("region"), F.col("o_orderpriority").alias("contest"), F.col("o_custkey").alias("option"), F.col("o_totalprice").alias("votes"))))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
