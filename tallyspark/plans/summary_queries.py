"""Registered queries: survey aggregates, coverage, priorities, overrides, area panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import summaries as A
from tallyspark.plans import fixtures as X
from tallyspark.plans.contest_queries import scores
from tallyspark.plans.fixtures import sql, table
from tallyspark.plans.registry import query


def micro(spark, d):
    line = table(spark, d, "lineitem")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


MICRO = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@query("a11_weighted_pct", f"SELECT s_nationkey, 100 * sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) AS pct {MICRO} GROUP BY 1")
def _(spark, d):
    return micro(spark, d).groupBy("s_nationkey").agg(A.weighted_pct(F.col("l_returnflag"), F.col("l_quantity"), ["R"]).alias("pct"))


@query("a12_weighted_mean", f"SELECT s_nationkey, sum(l_tax * l_quantity) / sum(l_quantity) AS mean {MICRO} GROUP BY 1")
def _(spark, d):
    return micro(spark, d).groupBy("s_nationkey").agg(A.weighted_mean(F.col("l_tax"), F.col("l_quantity")).alias("mean"))


@query("a13_microdata_features", f"SELECT s_nationkey, 100 * sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) AS returned, 100 * sum(l_quantity) FILTER (l_linestatus = 'O') / sum(l_quantity) AS open, sum(l_discount * l_quantity) / sum(l_quantity) AS discount, count(*) AS n_rows {MICRO} GROUP BY 1")
def _(spark, d):
    return A.microdata_features(micro(spark, d), ["s_nationkey"], "l_quantity", {"returned": ("l_returnflag", ["R"]), "open": ("l_linestatus", ["O"])}, {"discount": "l_discount"})


@query("a14_total_fertility", f"SELECT s_nationkey, sum(rate) AS tfr FROM (SELECT s_nationkey, l_quantity, sum(l_linenumber * l_tax) / nullif(sum(l_tax), 0) AS rate {MICRO} WHERE l_quantity BETWEEN 15 AND 49 GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return A.total_fertility(micro(spark, d), ["s_nationkey"], "l_quantity", "l_tax", "l_linenumber")


@query("a15_composite_region", "WITH c AS (SELECT c_mktsegment AS region, count(*)::DOUBLE AS people, avg(c_acctbal) AS balance FROM customer GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'MERGED', sum(people), sum(balance * people) / sum(people) FROM c WHERE region IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("region")).agg(F.count("*").cast("double").alias("people"), F.avg("c_acctbal").alias("balance"))
    return A.composite_region(rows, "region", ["BUILDING", "MACHINERY"], "MERGED", ["people"], ["balance"], "people")


@query("a16_rollup_rates", f"SELECT s_nationkey, 100 * sum(l_tax) / nullif(sum(l_discount), 0) AS rate, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey {MICRO} GROUP BY 1")
def _(spark, d):
    return A.rollup_rates(micro(spark, d), ["s_nationkey"], {"rate": ("l_tax", "l_discount")}, "l_suppkey")


LINKS = "SELECT c_mktsegment AS contest, n_name AS zone, count(*) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def links(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("zone"))
    return table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_mktsegment").alias("contest"), "zone")


@query("a17_crosswalk_shares", f"SELECT contest, zone, segments, total, CAST(round_even(CAST(segments AS DECIMAL(30, 12)) / total, 4) AS DOUBLE) AS share FROM (SELECT *, sum(segments) OVER (PARTITION BY contest) AS total FROM ({LINKS}))")
def _(spark, d):
    return A.crosswalk_shares(links(spark, d), "contest", "zone")


@query("w7_primary_role", f"SELECT contest, zone, segments, CASE WHEN row_number() OVER (PARTITION BY contest ORDER BY segments DESC, zone) = 1 THEN 'primary' ELSE 'secondary' END AS role FROM ({LINKS})")
def _(spark, d):
    return A.primary_role(links(spark, d), "contest", "zone")


@query("a18_group_actual_shares", sql("results option_dim", """, s AS (SELECT region, "group", sum(votes) AS votes FROM results JOIN option_dim USING (option) GROUP BY GROUPING SETS ((region, "group"), ("group"))) SELECT *, 100 * votes / sum(votes) OVER (PARTITION BY region) AS share FROM s"""))
def _(spark, d):
    return A.group_actual_shares(X.results(spark, d), X.option_dim(spark, d))


@query("a19_survey_overall", "SELECT user_id, avg(value) AS value FROM (SELECT *, bool_or(event_type = 'purchase' AND value > 80) OVER (PARTITION BY user_id) AS own, CASE WHEN event_type = 'purchase' AND value > 80 THEN 'overall' ELSE event_type END AS kind FROM events) WHERE (own AND kind = 'overall') OR (NOT own AND kind IN ('click', 'view')) GROUP BY 1")
def _(spark, d):
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), "overall").otherwise(F.col("event_type"))
    return A.survey_overall(table(spark, d, "events").withColumn("kind", kind), ["user_id"], "kind", "overall", ["click", "view"], "value")


CORR = [("l_quantity", f) for f in ("l_tax", "l_discount", "l_linenumber")] + [("l_extendedprice", f) for f in ("l_tax", "l_discount", "l_linenumber")]
CORR_SQL = " UNION ALL ".join(f"SELECT '{t}' AS target, '{f}' AS feature, count(*) AS n, corr({t}, {f}) AS r FROM lineitem" for t, f in CORR)


@query("a20_correlations", f"SELECT *, CASE WHEN r > 0.05 THEN 'positive' WHEN r < -0.05 THEN 'negative' ELSE 'near_zero' END AS direction FROM ({CORR_SQL})")
def _(spark, d):
    return A.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_tax", "l_discount", "l_linenumber"])


@query("a21_top_correlates", f"SELECT target, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign, row_number() OVER (PARTITION BY target, r > 0 ORDER BY abs(r) DESC, feature) AS rank, feature, r FROM ({CORR_SQL}) WHERE r <> 0 QUALIFY rank <= 2")
def _(spark, d):
    return A.top_correlates(A.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_tax", "l_discount", "l_linenumber"]), 2)


def sparse(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("region"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"), F.col("l_quantity").alias("target"))


SPARSE = "(SELECT l_orderkey, l_linenumber, l_returnflag AS region, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax, CASE WHEN l_discount > 0.05 THEN l_discount END AS discount, l_quantity AS target FROM lineitem)"


@query("a22_region_coverage", f"SELECT region, count(*) AS rows, count(coalesce(tax, discount)) AS covered, avg((CAST(tax IS NOT NULL AS INT) + CAST(discount IS NOT NULL AS INT)) / 2) AS mean_filled, count(*) - count(coalesce(tax, discount)) AS missing, CAST(round_even(CAST(100 * count(coalesce(tax, discount)) AS DECIMAL(30, 12)) / count(*), 2) AS DOUBLE) AS pct FROM {SPARSE} GROUP BY 1")
def _(spark, d):
    return A.region_coverage(sparse(spark, d), "region", ["tax", "discount"])


@query("a23_variable_coverage", " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS filled, 100 * count({v}) / count(*) AS pct, count(DISTINCT region) FILTER ({v} IS NOT NULL) AS regions, greatest(count({v}) FILTER (target IS NOT NULL), count({v}) FILTER (tax IS NOT NULL)) AS joint FROM {SPARSE}" for v in ("tax", "discount")))
def _(spark, d):
    return A.variable_coverage(sparse(spark, d), "region", ["tax", "discount"], ["target", "tax"])


@query("a24_missing_share", " UNION ALL ".join(f"SELECT '{v}' AS \"column\", avg(CAST({v} IS NULL AS INT)) AS missing FROM {SPARSE}" for v in ("tax", "discount", "target")))
def _(spark, d):
    return A.missing_share(sparse(spark, d), ["tax", "discount", "target"])


@query("a25_value_counts", f"SELECT tax, count(*) AS n FROM {SPARSE} GROUP BY 1")
def _(spark, d):
    return A.value_counts(sparse(spark, d), "tax")


@query("a27_catalog_usage", "SELECT p_brand, list_sort(list(DISTINCT p_type)) AS variables, list_sort(list(DISTINCT p_size % 5)) AS periods, count(DISTINCT p_name) AS contests FROM part GROUP BY 1")
def _(spark, d):
    return A.catalog_usage(table(spark, d, "part").withColumn("m", F.col("p_size") % 5), "p_brand", "p_type", "m", "p_name")


@query("a28_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev({c}) AS sd, min({c})::DOUBLE AS low, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, max({c})::DOUBLE AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _(spark, d):
    return A.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


W8 = "SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) % 3 AS v, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 4 AS conf, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 4 DESC, event_id) AS place FROM events"


@query("w8_dedupe_by_priority", f"""WITH e AS ({W8}), g AS (SELECT user_id, event_type, count(*) AS n, min(v) <> max(v) AS conflict, max(conf) AS top FROM e GROUP BY ALL)
    SELECT user_id, event_type, event_id, e.v, e.conf, n, conflict, CASE WHEN n = 1 THEN 'unique' WHEN NOT conflict THEN 'same_value' WHEN (SELECT count(*) FROM e q WHERE q.user_id = e.user_id AND q.event_type = e.event_type AND q.conf = top) = 1 THEN 'highest_confidence' ELSE 'conflict' END AS status
    FROM e JOIN g USING (user_id, event_type) WHERE place = 1""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.floor("value") % 3).alias("v"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4).alias("conf"))
    return A.dedupe_by_priority(rows, ["user_id", "event_type"], "v", "conf", [F.asc("event_id")])


@query("w9_duplicate_report", "SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(floor(value / 50) AS BIGINT)) AS values, list_sort(list(DISTINCT length(props))) AS sources, CASE WHEN count(DISTINCT CAST(floor(value / 50) AS BIGINT)) = 1 THEN 'keep one' ELSE 'review' END AS advice FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 50).alias("v"), F.char_length("props").cast("long").alias("s"))
    return A.duplicate_report(rows, ["user_id", "event_type"], "v", "s")


@query("w10_keep_first", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def _(spark, d):
    return A.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("w11_priority_rank", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part")
def _(spark, d):
    return A.priority_rank(table(spark, d, "part"), "p_size", "p_partkey").select("p_partkey", "rank")


@query("q1_basic_checks", sql("ranked", """, o AS (SELECT count(*) FILTER (winner) AS w, count(DISTINCT (period, contest)) AS c, count(*) FILTER (vote_share < 0 OR vote_share > 100) AS b, count(*) FILTER (vote_share IS NULL) AS z FROM ranked)
    SELECT 'winner count' AS "check", w = 2500 AS ok, w AS observed, 2500 AS expected FROM o UNION ALL SELECT 'one winner each', w = c, w, c FROM o UNION ALL SELECT 'share bounds', b = 0, b, 0 FROM o UNION ALL SELECT 'null shares', z = 0, z, 0 FROM o"""))
def _(spark, d):
    return A.basic_checks(X.ranked(spark, d), 2500)


@query("q2_apply_overrides", """WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer), o AS (SELECT o_custkey AS c_custkey, max_by(o_totalprice, o_orderkey) AS value, max_by(o_orderstatus = 'F', o_orderkey) AS allowed FROM orders GROUP BY 1),
    j AS (SELECT *, value IS NOT NULL AND (balance IS NULL OR allowed) AS takes FROM m LEFT JOIN o USING (c_custkey))
    SELECT c_custkey, CASE WHEN takes THEN value ELSE balance END AS balance, CASE WHEN takes AND balance IS NOT NULL THEN balance END AS balance_reference, CASE WHEN value IS NOT NULL AND NOT takes THEN value END AS balance_manual, CASE WHEN takes THEN 'manual' WHEN balance IS NOT NULL THEN 'generated' ELSE 'none' END AS balance_source FROM j""")
def _(spark, d):
    m = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("balance").alias("variable"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("allowed"), "o_orderkey")
    return A.apply_overrides(m, o, "c_custkey", ["balance"], "o_orderkey")


@query("q5_template_rows", f"SELECT l_orderkey, 'tax' AS variable FROM {SPARSE} WHERE tax IS NULL UNION ALL SELECT l_orderkey, 'discount' FROM {SPARSE} WHERE discount IS NULL")
def _(spark, d):
    return A.template_rows(sparse(spark, d), "l_orderkey", ["tax", "discount"])


@query("q10_contest_coverage", f"SELECT l_orderkey, CAST(tax IS NOT NULL AS INT) + CAST(discount IS NOT NULL AS INT) AS available, 2 - CAST(tax IS NOT NULL AS INT) - CAST(discount IS NOT NULL AS INT) AS missing, tax IS NOT NULL OR discount IS NOT NULL AS any FROM {SPARSE}")
def _(spark, d):
    return A.contest_coverage(sparse(spark, d), "l_orderkey", ["tax", "discount"])


@query("q13_alias_upsert", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey, 'P' FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    fixes = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("P").alias("c_mktsegment")).distinct()
    return A.alias_upsert(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), fixes, ["c_custkey"])


PANEL = f"(SELECT CASE WHEN n_nationkey % 7 > 0 OR l_shipdate >= TIMESTAMP '1998-06-01' THEN n_name END AS zone, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 1 ELSE 2 END AS survey, sum(l_tax * l_quantity) / sum(l_quantity) AS tax, CASE WHEN n_nationkey % 4 > 0 THEN 100 * sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) END AS returned {MICRO} JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, n_nationkey)"


def panel(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("zone"))
    old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
    rows = micro(spark, d).withColumn("survey", F.when(old, 1).otherwise(2))
    out = A.microdata_features(rows, ["s_nationkey", "survey"], "l_quantity", {"returned": ("l_returnflag", ["R"])}, {"tax": "l_tax"})
    zone = F.when((F.col("s_nationkey") % 7 > 0) | (F.col("survey") == 2), F.col("zone"))  # some zones have no name in the first round
    return out.join(n, "s_nationkey").select(zone.alias("zone"), "survey", "tax", F.when(F.col("s_nationkey") % 4 > 0, F.col("returned")).alias("returned"))


@query("d1_zone_panel", f"SELECT * FROM {PANEL}")
def _(spark, d):
    return panel(spark, d)


@query("d2_change_pairs", f"""WITH w AS (SELECT zone, max(tax) FILTER (survey = 1) AS tax_old, max(tax) FILTER (survey = 2) AS tax_new, max(returned) FILTER (survey = 1) AS returned_old, max(returned) FILTER (survey = 2) AS returned_new, bool_or(survey = 1) AS has_old, bool_or(survey = 2) AS has_new FROM {PANEL} GROUP BY 1)
    SELECT *, tax_new - tax_old AS tax_change, (tax_new - tax_old) / 5 AS tax_yearly, returned_new - returned_old AS returned_change, (returned_new - returned_old) / 5 AS returned_yearly, CASE WHEN NOT has_old OR NOT has_new THEN 'low' WHEN tax_new - tax_old IS NOT NULL AND returned_new - returned_old IS NOT NULL THEN 'high' ELSE 'medium' END AS quality FROM w""")
def _(spark, d):
    return A.change_pairs(panel(spark, d), ["zone"], "survey", 1, 2, ["tax", "returned"])


SHARES = f"(SELECT contest, zone, segments / sum(segments) OVER (PARTITION BY contest) AS share FROM ({LINKS}))"


def shares(spark, d):
    out = A.crosswalk_shares(links(spark, d), "contest", "zone")
    return out.select("contest", "zone", (F.col("segments") / F.col("total")).alias("share"))


def allocation_sql(weight: str) -> str:
    f = lambda c: f"sum({c} * share) / nullif({weight.format(c=c)}, 0) AS {c}"
    return f"SELECT contest, {f('tax')}, {f('returned')}, coalesce(sum(share) FILTER (survey IS NOT NULL), 0) AS coverage FROM {SHARES} LEFT JOIN (SELECT * FROM {PANEL} WHERE survey = 1) USING (zone) GROUP BY 1"


@query("d4_allocate", allocation_sql("sum(share) FILTER ({c} IS NOT NULL)"))
def _(spark, d):
    return A.allocate(shares(spark, d), panel(spark, d).where("survey = 1").drop("survey"), "contest", "zone", ["tax", "returned"])


@query("d5_allocate_simple", allocation_sql("sum(share) FILTER (survey IS NOT NULL)"))
def _(spark, d):
    return A.allocate(shares(spark, d), panel(spark, d).where("survey = 1").drop("survey"), "contest", "zone", ["tax", "returned"], by_value=False)


@query("d6_contest_change", f"""WITH a AS (SELECT contest, survey, sum(tax * share) / nullif(sum(share) FILTER (tax IS NOT NULL), 0) AS tax FROM {SHARES} JOIN {PANEL} USING (zone) GROUP BY 1, 2)
    SELECT contest, max(tax) FILTER (survey = 1) AS tax_old, max(tax) FILTER (survey = 2) AS tax_new, max(tax) FILTER (survey = 2) - max(tax) FILTER (survey = 1) AS tax_change FROM a GROUP BY 1""")
def _(spark, d):
    rows = panel(spark, d)
    both = A.allocate(shares(spark, d), rows.where("survey = 1").drop("survey"), "contest", "zone", ["tax"]).withColumn("survey", F.lit(1)).unionByName(A.allocate(shares(spark, d), rows.where("survey = 2").drop("survey"), "contest", "zone", ["tax"]).withColumn("survey", F.lit(2)))
    return A.change_pairs(both, ["contest"], "survey", 1, 2, ["tax"]).select("contest", "tax_old", "tax_new", "tax_change")


@query("c9_key_factors", sql("volatility", """SELECT contest, list_filter([CASE WHEN flipped THEN 'flipped' END, CASE WHEN top2_margin_pct <= 5 THEN 'close' END, CASE WHEN effective_options > 10 THEN 'fragmented' END, CASE WHEN mean_abs_swing > 3 THEN 'volatile' END], lambda x: x IS NOT NULL) AS tags FROM volatility"""))
def _(spark, d):
    from tallyspark.operators import profiles

    return scores(spark, d).select("contest", profiles.key_factors().alias("tags"))


@query("c8_priority_contests", sql("volatility", """, r AS (SELECT contest, 'flipped' AS reason, 30 AS points, 1 AS k FROM volatility WHERE flipped UNION ALL SELECT contest, 'close', 25, 2 FROM (SELECT contest FROM volatility WHERE top2_margin_pct IS NOT NULL ORDER BY top2_margin_pct, contest LIMIT 25)
    UNION ALL SELECT contest, 'volatile', 20, 3 FROM (SELECT contest FROM volatility WHERE score IS NOT NULL ORDER BY score DESC, contest LIMIT 25))
    SELECT contest, sum(points) AS points, list(reason ORDER BY k) AS reasons, sum(points) >= 30 AS review FROM r GROUP BY 1"""))
def _(spark, d):
    from tallyspark.operators import profiles

    return profiles.priority_contests(scores(spark, d))


@query("c13_rank_flags", sql("swings", "SELECT contest, option, swing > 3 AS large_gain, swing < -3 AS large_loss FROM swings"))
def _(spark, d):
    from tallyspark.operators import contest as C

    return C.option_swings(*X.periods(spark, d)).select("contest", "option", (F.col("swing") > 3).alias("large_gain"), (F.col("swing") < -3).alias("large_loss"))


@query("c11_merge_notes", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'm' || o_custkey ELSE o_orderpriority END AS note, CASE WHEN o_custkey % 3 = 0 THEN 'manual' ELSE 'generated' END AS source FROM orders")
def _(spark, d):
    from tallyspark.operators import profiles

    orders = table(spark, d, "orders")
    manual = orders.select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("m"), "o_custkey")).otherwise(" n/a ").alias("note"))
    return profiles.merge_notes(orders.select("o_orderkey", F.col("o_orderpriority").alias("note")), manual, "o_orderkey", ["note"])
