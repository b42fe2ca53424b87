"""Registered queries: contest profiles, review reports, region bridge, coded totals, curated cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import contest as C
from tallyspark.operators import profiles as P
from tallyspark.operators import surveys as V
from tallyspark.plans.contest_queries import features, scores
from tallyspark.plans.fixtures import sql, table
from tallyspark.plans.registry import query
from tallyspark.plans.relational_queries import PAIR, survey_pair


@query("c10_contest_profile", sql("volatility", """SELECT contest, list_filter([CASE WHEN flipped THEN 'flipped' END, CASE WHEN top2_margin_pct <= 5 THEN 'close' END, CASE WHEN effective_options > 10 THEN 'fragmented' END, CASE WHEN mean_abs_swing > 3 THEN 'volatile' END], lambda x: x IS NOT NULL) AS tags,
    concat_ws(' ', CASE WHEN flipped THEN 'Moved from ' || prev_winner || ' to ' || curr_winner || '.' ELSE 'Held by ' || curr_winner || '.' END, CASE WHEN top2_margin_pct <= 5 THEN 'The margin is narrow.' END) AS text,
    CASE WHEN top2_margin_pct IS NOT NULL AND mean_abs_swing IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, CASE WHEN score IS NOT NULL THEN 'complete' ELSE 'partial' END AS quality FROM volatility"""))
def _(spark, d):
    return P.contest_profile(scores(spark, d))


@query("c12_review_report", "SELECT o_orderkey, o_orderstatus = 'F' AS has_manual, true AS review, CASE WHEN o_custkey % 4 = 0 THEN 'blank note' ELSE 'short note' END AS reasons FROM orders")
def _(spark, d):
    notes = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, " none ").otherwise(F.col("o_orderpriority")).alias("note"), F.when(F.col("o_orderstatus") == "F", "manual").otherwise("generated").alias("source"))
    return P.review_report(notes, "o_orderkey", ["note"])


@query("c14_insight_flags", sql("features", "SELECT contest, list_filter([CASE WHEN top2_margin_pct < 3 THEN 'narrow' END, CASE WHEN effective_options > 12 THEN 'crowded' END, CASE WHEN winner_share > 20 THEN 'strong' END], lambda x: x IS NOT NULL) AS insights FROM features WHERE period = 2"))
def _(spark, d):
    rules = [("narrow", "top2_margin_pct", "<", 3), ("crowded", "effective_options", ">", 12), ("strong", "winner_share", ">", 20)]
    return P.insight_flags(features(spark, d, "curr"), rules).select("contest", "insights")


@query("c7_region_bridge", sql("features", """, o AS (SELECT region, count(*) AS seats FROM features WHERE period = 2 GROUP BY 1), f AS (SELECT CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS region, sum(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT o.region, seats, CASE WHEN a.region IS NOT NULL THEN a.balance WHEN b.region IS NOT NULL THEN b.balance WHEN c.region IS NOT NULL THEN c.balance END AS balance, CASE WHEN a.region IS NOT NULL THEN 'exact' WHEN b.region IS NOT NULL THEN 'composite' WHEN c.region IS NOT NULL THEN 'legacy' ELSE 'none' END AS match
    FROM o LEFT JOIN f a ON a.region = o.region LEFT JOIN f b ON o.region = 'NATION_4' AND b.region = 'NATION_5' LEFT JOIN f c ON o.region = 'NATION_8' AND c.region = 'NATION_9'"""))
def _(spark, d):
    outcomes = C.seat_counts(features(spark, d, "curr"), ["region"])
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("region"))
    facts = table(spark, d, "supplier").join(nation, "s_nationkey").groupBy("region").agg(F.sum("s_acctbal").alias("balance"))
    one = lambda a, b: spark.createDataFrame([(a, b)], "region string, other string")
    return P.region_bridge(outcomes, facts, "region", one("NATION_4", "NATION_5"), one("NATION_8", "NATION_9"))


@query("d3_reassign_region", "SELECT c_custkey, CASE WHEN c_nationkey % 6 = 0 THEN 'NEW' ELSE c_mktsegment END AS region, c_mktsegment AS region_old FROM customer")
def _(spark, d):
    moves = table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.col("n_nationkey").alias("zone"), F.lit("NEW").alias("new_region"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("region"))
    return P.reassign_region(rows, "region", "c_nationkey", moves).drop("c_nationkey")


CODED = "SELECT lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS F_o_totalprice, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS O_o_totalprice, CASE WHEN sum(o_totalprice) FILTER (o_orderstatus = 'F') > 0 THEN sum(o_totalprice) FILTER (o_orderstatus = 'O') / sum(o_totalprice) FILTER (o_orderstatus = 'F') * 100 END AS O_o_totalprice_pct FROM orders GROUP BY 1"


@query("d10_coded_totals", CODED)
def _(spark, d):
    return P.coded_totals(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O"], ["o_totalprice"], 5)


@query("d11_region_census", "WITH a AS (SELECT CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS k, sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, sum(s_acctbal) AS x FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    from tallyspark.operators import relational as R

    a = table(spark, d, "customer").groupBy(F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("k")).agg(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("x"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("x"))
    return R.coalesce_join(a, b, ["k"], ["x"], how="full_outer")


@query("d9_zone_master", "SELECT n_nationkey, n_name, coalesce(c, s) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, max(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal END) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def _(spark, d):
    from tallyspark.operators import relational as R

    first = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_acctbal"))).alias("balance"))
    second = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("balance"))
    spine = R.multi_left_join(table(spark, d, "nation").select("n_nationkey", "n_name"), [(first, ["n_nationkey"])])
    return R.coalesce_join(spine, second, ["n_nationkey"], ["balance"])


@query("v10_curated_comparison", PAIR + """, a AS (SELECT g, dom, max(share) AS x, count(DISTINCT share) AS n FROM pre GROUP BY ALL), b AS (SELECT g, dom, max(share) AS y, count(DISTINCT share) AS m FROM post GROUP BY ALL)
    SELECT g, dom, x AS share_pre, y AS share_post, y - x AS shift FROM a JOIN b USING (g, dom) WHERE n = 1 AND m = 1""")
def _(spark, d):
    from tallyspark.operators import relational as R

    trusted = [V.curate([side.withColumn("confidence", F.lit(1))], ["g", "dom"], "share").where("not conflict").select("g", "dom", "share") for side in survey_pair(spark, d)]
    return R.one_to_one_join(*trusted, ["g", "dom"], "share")
