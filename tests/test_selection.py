"""Selection and places in order against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import selection


def values(seed, n):
    draw = random.Random(seed)
    kinds = [lambda: 0.0, lambda: draw.gauss(0, 1), lambda: draw.gauss(0, 1e-300), lambda: draw.gauss(0, 1e300), lambda: float(draw.randint(-5, 5)), lambda: 2.0 ** draw.randint(-1000, 1000), lambda: math.inf, lambda: -math.inf, lambda: 1 + draw.random() * 1e-12, lambda: None]
    return [draw.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("bins,few", [(4, 1), (16, 3), (512, 4096)])
def test_select_ranks(spark, bins, few):
    rows = [("hot" if i % 3 else [None, "a", "b"][i % 7 % 3], v) for i, v in enumerate(values(1, 1200))] + [("null", None)]
    have = {}
    for k, v in rows:
        if v is not None:
            have.setdefault(k, []).append(v)
    asked = [(k, p) for k, vs in have.items() for p in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}]
    df = spark.createDataFrame(rows, "k string, v double")
    got = selection.select_ranks(df, ["k"], "v", spark.createDataFrame(asked + asked, "k string, place long"), bins=bins, few=few).collect()
    assert sorted([(str(r.k), r.place, r.value) for r in got]) == sorted((str(k), p, sorted(have[k])[p]) for k, p in asked)


def test_percentiles(spark):
    rows = [(i % 2, v) for i, v in enumerate(v for v in values(3, 800) if v is None or abs(v) < 1e200)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = {"q1": 0.25, "median": 0.5, "q9": 0.9}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()]).collect()}
    got = {r.k: r for r in selection.percentiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][n], want[k][n], rel_tol=1e-12, abs_tol=0) for k in got for n in shares)
    [whole] = selection.percentiles(df, [], "v", shares).collect()
    assert math.isclose(whole.median, df.agg(F.percentile("v", F.lit(0.5))).first()[0], rel_tol=1e-12)
    assert selection.percentiles(df.limit(0), ["k"], "v", shares).isEmpty()


def test_weighted_percentiles_take_the_lower_row(spark):
    counts = [("a", 1.0, 3), ("a", 5.0, 1), ("a", None, 9), ("a", 7.0, 0), ("b", 2.0, 1), (None, 4.0, 2)]
    got = {r.k: (r.p10, r.p90) for r in selection.percentiles(spark.createDataFrame(counts, "k string, v double, n long"), ["k"], "v", {"p10": 0.1, "p90": 0.9}, weight="n", between=False).collect()}
    assert got == {"a": (1.0, 1.0), "b": (2.0, 2.0), None: (4.0, 4.0)}


def test_one_key_with_all_rows_has_no_window_or_percentile(spark):
    df = spark.range(50_000).select(F.lit("k").alias("k"), (F.xxhash64("id") % 100_003).cast("double").alias("v"))
    found = selection.percentiles(df, ["k"], "v", {"median": 0.5})
    plan = found._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "window" not in plan
    assert found.first()["median"] == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ordered(spark, groups):
    draw = random.Random(6)
    rows = [(draw.choice(["hot", "hot", "a", None]), draw.choice([None, 1.0, draw.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, s double, k long")
    got = selection.ordered(df.repartition(7), groups, [F.desc_nulls_last("s"), F.asc("k")], "rank").collect()
    key = lambda r: ((r[1] is None, -(r[1] or 0)), r[2])
    want = {}
    for g in {r[0] for r in rows} if groups else [0]:
        want |= {r[2]: i for i, r in enumerate(sorted((r for r in rows if not groups or r[0] == g), key=key), 1)}
    assert {r.k: r["rank"] for r in got} == want
    assert selection.ordered(df.limit(0), groups, [F.asc("k")]).isEmpty()
