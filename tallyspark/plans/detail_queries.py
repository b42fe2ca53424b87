"""Registered queries: sinks read back, name rules, and the parts of profiles, panels and lists that go beyond their first queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import contest as C
from tallyspark.operators import profiles as P
from tallyspark.operators import relational as R
from tallyspark.operators import summaries as A
from tallyspark.operators import surveys as V
from tallyspark.plans import fixtures as X
from tallyspark.plans.contest_queries import KEY, pairs
from tallyspark.plans.fixtures import sql, table
from tallyspark.plans.registry import query
from tallyspark.plans.summary_queries import MICRO, micro
from tallyspark.sources import tables as T
from tallyspark.sources.shared import new_path, stored


@query("io2_write_table", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    path, orders = new_path(spark, "orders"), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    T.write_table(orders, path, "o_orderstatus")
    T.write_table(orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", -F.col("o_totalprice")), path, "o_orderstatus")
    return T.read_table(spark, path)


@query("io7_read_tables_union", """SELECT CAST(c_custkey AS VARCHAR) AS a, c_name || ', "' || c_mktsegment || '"' AS b, CASE WHEN c_nationkey % 2 = 0 THEN '' || c_nationkey END AS c, CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM customer""")
def _(spark, d):
    path, rows = new_path(spark, "lines"), table(spark, d, "customer")
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'))
    rows.select(F.concat_ws(",", "c_custkey", quoted, F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")))).write.text(path)
    cells = T.read_tables_union(spark, path)
    return cells.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate("abc")], F.size("cells").alias("n"))


@query("io8_nested_documents", "SELECT n_regionkey, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def _(spark, d):
    nested = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))  # as many as a region has
    path = new_path(spark, "documents")
    T.write_json_documents(nested, path)
    back = spark.read.json(path)
    return back.select("n_regionkey", F.size("nations").cast("long").alias("nations"), F.array_join("nations.n_name", ",").alias("names"))


@query("io11_read_feature_properties", "SELECT n_nationkey, n_name, replace(n_name, '_', ' ') AS key FROM nation")
def _(spark, d):
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.struct("n_nationkey", "n_name").alias("properties"), F.lit("Feature").alias("type"))).alias("features"))
    path = new_path(spark, "features")
    lists.select("features").repartition(5).write.json(path)
    return T.read_feature_properties(spark, path, {"key": S.norm_key(F.col("n_name"), punctuation=True)})


@query("s5_normalise_spellings", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ECO' ELSE p_type END AS party FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalise_party(F.concat(F.lit("  "), F.lower("p_type"), F.lit(" ")), {"ECONOMY": "ECO"}).alias("party"))


@query("s9_lookup_key", "SELECT p_partkey, upper(p_name) || ' AND ' || p_type || '::' || replace(upper(p_brand), '#', ' ') AS key FROM part")
def _(spark, d):
    left = S.norm_key(F.concat("p_name", F.lit(" & "), "p_type", F.lit(".(sc)")), punctuation=True)
    return table(spark, d, "part").select("p_partkey", F.concat_ws("::", left, S.norm_key(F.col("p_brand"), punctuation=True)).alias("key"))


@query("s11_extent_name", "SELECT p_partkey, p_type || ' Rural' AS by_marker, p_type || ' city' AS by_comma, p_type AS by_case, p_brand AS one FROM part")
def _(spark, d):
    t, f = F.col("p_type"), S.extent_name
    return table(spark, d, "part").select(
        "p_partkey", f(F.concat(t, F.lit(" (SC) Rural CD Blocks of "), "p_name")).alias("by_marker"), f(F.concat(t, F.lit(" city, and more"))).alias("by_comma"),
        f(F.concat_ws(" ", t, "p_name")).alias("by_case"), f(F.col("p_brand")).alias("one"),
    )


@query("s22_sentences", """SELECT n_nationkey, 'Zone ' || n_name || ' has key ' || n_nationkey || '.' || CASE WHEN n_nationkey = 12 THEN ' It was stable.' WHEN n_nationkey > 12 THEN ' It rose by ' || (n_nationkey - 12) || '.0 points.' ELSE ' It fell by ' || (12 - n_nationkey) || '.0 points.' END AS text FROM nation""")
def _(spark, d):
    n = F.col("n_nationkey")
    text = S.template_text(S.sentence("Zone %s has key %s.", F.col("n_name"), n.cast("string")), S.swing_sentence("It", (n - 12).cast("double")), S.sentence("Never %s.", F.lit(None).cast("string")))
    return table(spark, d, "nation").select("n_nationkey", text.alias("text"))


@query("j20_exclusion_reasons", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.exclusion_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), used, "o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")).drop("o_orderstatus")


@query("a7_region_key_seats", sql("features", """SELECT region, p0 AS prev_0, c0 AS curr_0, c0 - p0 AS change_0, p1 AS prev_1, c1 AS curr_1, c1 - p1 AS change_1 FROM (
    SELECT region, count(*) FILTER (period = 1 AND winner = 'Brand#1') AS p0, count(*) FILTER (period = 2 AND winner = 'Brand#1') AS c0, count(*) FILTER (period = 1 AND winner = 'Brand#2') AS p1, count(*) FILTER (period = 2 AND winner = 'Brand#2') AS c1
    FROM features GROUP BY region HAVING count(*) FILTER (period = 2) > 0)"""))
def _(spark, d):
    found = stored(pairs(spark, d), "pairs")
    out = C.region_outcomes(C.features_of(found, "curr"), C.volatility_of(found), X.option_dim(spark, d), prev=C.features_of(found, "prev"), key_options=KEY)
    return out.select("region", *[f"{n}_{k}" for k in (0, 1) for n in ("prev", "curr", "change")])


ROWS = """, rows AS (
    SELECT v.contest, v.region, v.flipped, v.top2_margin_pct AS margin, a.swing AS swing_a, b.swing AS swing_b, p.votes / 100 AS turnout_prev, c.votes / 100 AS turnout_curr, 4 * v.top2_margin_pct AS urban,
           CASE WHEN v.mean_abs_swing < 8 THEN v.effective_options / 20 END AS coverage, CASE WHEN v.mean_abs_swing >= 8 THEN 'election_only' WHEN v.effective_options > 16 THEN 'high' ELSE 'medium' END AS quality,
           CASE WHEN v.effective_options < 10 THEN v.region END AS zones_missing
    FROM volatility v LEFT JOIN (SELECT contest, swing FROM swings WHERE option = 'Brand#1') a USING (contest) LEFT JOIN (SELECT contest, swing FROM swings WHERE option = 'Brand#2') b USING (contest)
    LEFT JOIN (SELECT contest, sum(votes) AS votes FROM results WHERE period = 1 GROUP BY 1) p USING (contest) LEFT JOIN (SELECT contest, sum(votes) AS votes FROM results WHERE period = 2 GROUP BY 1) c USING (contest)) """


def profile_rows(spark, d):
    found = pairs(spark, d, KEY)
    of = found.select("contest", *[F.col(f"`{o}_swing`").alias(f"swing_{n}") for n, o in zip("ab", KEY)])
    votes = X.results(spark, d).groupBy("contest").agg(*[(F.sum(F.when(F.col("period") == k, F.col("votes"))) / 100).alias(f"turnout_{n}") for k, n in ((1, "prev"), (2, "curr"))])
    rows = C.volatility_of(found).join(of, "contest", "left").join(votes, "contest", "left")
    few, n = F.col("mean_abs_swing") < 8, F.col("effective_options")
    return rows.select(
        "contest", "region", "flipped", F.col("top2_margin_pct").alias("margin"), "swing_a", "swing_b", "turnout_prev", "turnout_curr", F.lit(None).cast("double").alias("turnout_change"), (4 * F.col("top2_margin_pct")).alias("urban"),
        F.when(few, n / 20).alias("coverage"), F.when(~few, "election_only").when(n > 16, "high").otherwise("medium").alias("quality"), F.when(n < 10, F.col("region")).alias("zones_missing"),
    )


NEEDED = "volatility swings results"


@query("a10_region_quality", sql(NEEDED, ROWS + """SELECT * EXCLUDE (high), CASE WHEN high >= 0.5 * contests THEN 'high' WHEN covered = 0 THEN 'election_only' WHEN mean_coverage >= 0.75 THEN 'high' WHEN mean_coverage >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM (
    SELECT region, count(*) AS contests, count(coverage) AS covered, 100.0 * count(coverage) / count(*) AS coverage_pct, avg(turnout_curr - turnout_prev) AS turnout_change, avg(coverage) AS mean_coverage, count(*) FILTER (quality = 'high') AS high FROM rows GROUP BY region)"""))
def _(spark, d):
    return C.region_quality(profile_rows(spark, d))


@query("c9_profile_tags", sql(NEEDED, ROWS + """SELECT contest, list_filter([CASE WHEN flipped THEN 'flip' END, CASE WHEN margin <= 5 THEN 'close' END, CASE WHEN swing_a >= 10 THEN 'large_gain_a' END, CASE WHEN swing_a <= -10 THEN 'large_loss_a' END,
    CASE WHEN swing_b >= 10 THEN 'large_gain_b' END, CASE WHEN swing_b <= -10 THEN 'large_loss_b' END, CASE WHEN abs(turnout_curr - turnout_prev) >= 5 THEN 'turnout_shift' END, CASE WHEN urban >= 50 THEN 'urban' END, CASE WHEN urban < 30 THEN 'rural' END,
    CASE WHEN coverage >= 0.75 THEN 'well_covered' END, CASE WHEN coverage < 0.5 THEN 'thinly_covered' END, CASE WHEN quality = 'election_only' THEN 'results_only' END, CASE WHEN zones_missing <> '' THEN 'zones_missing' END], lambda x: x IS NOT NULL) AS tags FROM rows"""))
def _(spark, d):
    return profile_rows(spark, d).select("contest", P.profile_tags().alias("tags"))


PRIORITY = ROWS + """, r AS (SELECT contest, 'flip' AS reason, 30 AS points FROM rows WHERE flipped UNION ALL SELECT contest, 'major', 15 FROM rows WHERE contest LIKE '%#_#_7' ESCAPE '#'
    UNION ALL SELECT contest, 'close', 25 FROM (SELECT contest FROM rows WHERE margin IS NOT NULL ORDER BY margin, contest LIMIT 25)
    UNION ALL SELECT contest, 'gain_a', 20 FROM (SELECT contest FROM rows WHERE swing_a IS NOT NULL ORDER BY swing_a DESC, contest LIMIT 25) UNION ALL SELECT contest, 'loss_a', 20 FROM (SELECT contest FROM rows WHERE swing_a IS NOT NULL ORDER BY swing_a, contest LIMIT 25)
    UNION ALL SELECT contest, 'gain_b', 20 FROM (SELECT contest FROM rows WHERE swing_b IS NOT NULL ORDER BY swing_b DESC, contest LIMIT 25) UNION ALL SELECT contest, 'loss_b', 20 FROM (SELECT contest FROM rows WHERE swing_b IS NOT NULL ORDER BY swing_b, contest LIMIT 25)
    UNION ALL SELECT contest, 'flip', 30 FROM rows WHERE flipped AND margin < 1)
    , priority AS (SELECT contest, CAST(sum(points) AS BIGINT) AS points, list_sort(list(DISTINCT reason)) AS reasons, sum(points) >= 30 AS review FROM r GROUP BY 1) """


def priority(spark, d, rows):
    majors = table(spark, d, "nation").select(F.concat("n_name", F.lit("__7")).alias("contest"))
    return P.priority_list(rows, majors, rows.where("flipped and margin < 1").select("contest", F.lit("flip").alias("reason")))


@query("c8_priority_list", sql(NEEDED, PRIORITY + "SELECT *, row_number() OVER (ORDER BY points DESC, contest) AS rank FROM priority"))
def _(spark, d):
    return priority(spark, d, stored(profile_rows(spark, d), "profiles"))


@query("c13_profile_flags", sql(NEEDED, PRIORITY + """SELECT contest, coalesce(flipped, false) AS is_flipped, coalesce(margin <= 5, false) AS is_close, coalesce(swing_a >= 10, false) AS is_large_gain_a, coalesce(swing_a <= -10, false) AS is_large_loss_a,
    coalesce(swing_b >= 10, false) AS is_large_gain_b, coalesce(swing_b <= -10, false) AS is_large_loss_b, contest IN (SELECT contest FROM priority) AS is_priority FROM rows"""))
def _(spark, d):
    rows = stored(profile_rows(spark, d), "profiles")
    return P.rank_flags(rows, priority(spark, d, rows))


@query("t2_movement_lists", sql(NEEDED, ROWS + """SELECT region, contest, margin, flipped, 'closest' AS list, row_number() OVER (PARTITION BY region ORDER BY margin, contest) AS rank FROM rows WHERE margin IS NOT NULL QUALIFY rank <= 10
    UNION ALL SELECT region, contest, margin, flipped, 'flipped', row_number() OVER (PARTITION BY region ORDER BY margin, contest) AS rank FROM rows WHERE flipped AND margin IS NOT NULL QUALIFY rank <= 10"""))
def _(spark, d):
    return R.movement_lists(profile_rows(spark, d).select("region", "contest", "margin", "flipped"))


@query("a14_fertility_or_mean", f"""SELECT s_nationkey, CASE WHEN sum(seen) > 0 THEN sum(rate) ELSE sum(born) / sum(women) END AS tfr FROM (SELECT s_nationkey, l_quantity, coalesce(sum(b * l_tax), 0) / nullif(sum(l_tax), 0) AS rate, count(b) AS seen,
    sum(l_linenumber * l_tax) FILTER (l_tax > 0) AS born, sum(l_tax) FILTER (l_tax > 0) AS women FROM (SELECT *, CASE WHEN s_nationkey < 20 AND l_returnflag = 'R' THEN l_linenumber END AS b {MICRO}) WHERE l_quantity BETWEEN 15 AND 49 GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    rows = micro(spark, d).withColumn("births", F.when((F.col("s_nationkey") < 20) & (F.col("l_returnflag") == "R"), F.col("l_linenumber")))
    return A.total_fertility_or_mean(rows, ["s_nationkey"], "l_quantity", "l_tax", "births", "l_linenumber")


@query("q13_alias_coverage", "SELECT count(*) AS keys, count(*) FILTER (b) AS before, count(*) FILTER (b OR a) AS after, 100.0 * count(*) FILTER (b) / count(*) AS before_pct, 100.0 * count(*) FILTER (b OR a) / count(*) AS after_pct FROM (SELECT c_acctbal > 2000 AS b, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS a FROM customer)")
def _(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    before = customer.where("c_acctbal > 2000").drop("c_acctbal")
    fixes = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("P").alias("c_mktsegment")).distinct()
    return A.alias_coverage(customer, before, A.alias_upsert(before, fixes, ["c_custkey"]), "c_custkey")


@query("v1_match_patterns", "SELECT p_partkey, CASE WHEN p_name LIKE '% ring' THEN NULL WHEN contains(p_name, 'widget') THEN 'W' WHEN regexp_matches(p_name, '^(red|blue) ') THEN 'PRIMARY' WHEN regexp_matches(p_name, 'l') THEN 'L' END AS canonical FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(~F.col("p_name").endswith(" ring"), F.col("p_name")).otherwise(" Don't Know ").alias("label"))
    return V.match_label(part, "label", {"widget": "W"}, ["don't know"], [("^(red|blue) ", "PRIMARY"), ("l", "L")]).select("p_partkey", "canonical")


@query("d9_zone_table", "SELECT n_name AS zone_id, n_name, coalesce(c, s) AS balance, CAST(n AS DOUBLE) AS people FROM nation LEFT JOIN (SELECT c_nationkey, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 3000) AS c, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def _(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rich = F.max(F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 3000), F.col("c_acctbal")))
    first = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(rich.alias("balance"), F.count("*").alias("people")).join(nation, "n_nationkey")
    second = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("balance")).join(nation, "n_nationkey")
    return P.zone_master(nation, "n_name", [first, second], ["balance", "people"])


@query("d11_region_levels", """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS lv, sum(c_acctbal) FILTER (c_acctbal > 3000) AS v FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS k, 'BUILDING' AS lv, sum(s_acctbal) AS v FROM supplier GROUP BY 1),
    m AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.lv, b.lv) AS lv, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.k = b.k AND a.lv = b.lv), w AS (SELECT k, max(v) FILTER (lv = 'BUILDING') AS BUILDING, max(v) FILTER (lv = 'MACHINERY') AS MACHINERY FROM m WHERE v IS NOT NULL AND lv IN ('BUILDING', 'MACHINERY') GROUP BY k)
    SELECT *, 100 * MACHINERY / nullif(BUILDING, 0) AS MACHINERY_pct FROM w""")
def _(spark, d):
    first = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("lv"), F.when(F.col("c_acctbal") > 3000, F.col("c_acctbal")).alias("v"))
    second = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("BUILDING").alias("lv"), F.col("s_acctbal").alias("v"))
    return P.region_census([first, second], "k", "lv", "v", ["BUILDING", "MACHINERY"])
