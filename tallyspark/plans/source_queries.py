"""Registered queries: sources and sinks, worklists and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import worklists as W
from tallyspark.plans.fixtures import table
from tallyspark.plans.registry import query
from tallyspark.plans.summary_queries import LINKS, PANEL, SHARES, links, panel, shares
from tallyspark.sources import tables as S


@query("io1_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return S.read_table(spark, f"{d}/orders.parquet", period="F", period_col="o_orderstatus").select("o_orderkey", "o_totalprice")


@query("io3_read_first_existing", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return S.read_first_existing(spark, [f"{d}/no_such.parquet", f"{d}/nation.parquet"]).select("n_nationkey", "n_name")


@query("io5_route_by_name", "SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), '/fr/') THEN 'french' ELSE 'unknown' END AS route FROM pages")
def _(spark, d):
    return S.route_by_name(table(spark, d, "pages"), "url", {"/EN/": "english", "/fr/": "french"}).select("page_id", "route")


@query("io6_parse_file_name", r"SELECT page_id, CASE WHEN h THEN regexp_extract(url, '/([a-z]{2})/(\d+)', 1) END AS lang, CASE WHEN h THEN regexp_extract(url, '/([a-z]{2})/(\d+)', 2) END AS number, h AS parsed, CASE WHEN h THEN '' ELSE 'name does not fit' END AS note FROM (SELECT *, regexp_matches(url, '/([a-z]{2})/(\d+)') AS h FROM pages)")
def _(spark, d):
    return S.parse_file_name(table(spark, d, "pages").select("page_id", "url"), "url", r"/([a-z]{2})/(\d+)", ["lang", "number"]).drop("url")


@query("io8_json_documents", "SELECT c_custkey, '{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS document FROM customer")
def _(spark, d):
    return S.json_documents(table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey"])


@query("io9_load_relational", "SELECT o_orderkey, c_custkey AS customer_id FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, d):
    dim = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" cust "), "c_custkey").alias("name"))
    facts = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("CUST "), "o_custkey").alias("who"))
    return S.load_relational(facts, {"customer_id": (dim, "name", "who")}).drop("who")


@query("io10_append_dedup", "SELECT k, kind FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, kind) AS i FROM (SELECT l_partkey AS k, l_returnflag AS kind, 0 AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_linestatus, 1 FROM lineitem)) WHERE i = 1")
def _(spark, d):
    line = table(spark, d, "lineitem")
    return S.append_dedup(line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("kind")), line.select(F.col("l_partkey").alias("k"), F.col("l_linestatus").alias("kind")), ["k"], [F.asc("kind")])


@query("io10_append_unseen", "SELECT DISTINCT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return S.append_unseen(table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("io12_rules_table", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'modest' WHEN p_type = 'LARGE' THEN 'big' END AS canonical FROM part")
def _(spark, d):
    rules = S.rules_table(spark, {"modest": ["SMALL", "MEDIUM"], "big": ["LARGE"]}).select(F.col("alias").alias("p_type"), "canonical")
    return table(spark, d, "part").join(F.broadcast(rules), "p_type", "left").select("p_partkey", "canonical")


GAPS = "(SELECT c_custkey, c_mktsegment AS region, CASE WHEN c_acctbal > 2000 THEN c_acctbal END AS a, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey END AS b FROM customer)"


def gaps(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("region"), F.when(F.col("c_acctbal") > 2000, F.col("c_acctbal")).alias("a"), F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey")).alias("b"))


@query("q3_override_summary", f"SELECT c_custkey, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) AS manual_fields, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'manual' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'mixed' ELSE 'generated' END AS source_type FROM {GAPS}")
def _(spark, d):
    rows = gaps(spark, d).withColumns({f"{v}_source": F.when(F.col(v).isNotNull(), "manual").otherwise("generated") for v in "ab"})
    return W.override_summary(rows, "c_custkey", ["a", "b"])


@query("q4_validate_overrides", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, s ORDER BY o_orderkey) AS n FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS s FROM orders))
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_totalprice > 300000 THEN 'invalid' WHEN n > 1 THEN 'duplicate' WHEN s = ' ' THEN 'incomplete' ELSE 'valid' END AS status FROM o""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("source"))
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return W.validate_overrides(rows, "o_custkey", known, ["source"], 0, 300000, "o_orderkey").select("o_orderkey", "status")


@query("q6_progress", f"SELECT region, count(*) AS contests, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS complete, count(a) + count(b) AS cells, 100 * (count(a) + count(b)) / (2 * count(*)) AS pct FROM {GAPS} GROUP BY 1")
def _(spark, d):
    return W.progress(gaps(spark, d), "region", ["a", "b"])


WORK = f"""(SELECT *, CASE WHEN category = 'complete' THEN 3 WHEN CASE category WHEN 'no_data' THEN 2 ELSE 1 END + CAST(hot AS INT) + CAST(gaps >= 10 AS INT) >= 3 THEN 1 ELSE 2 END AS priority FROM (
    SELECT *, count(*) FILTER (category <> 'complete') OVER (PARTITION BY region) AS gaps FROM (SELECT c_custkey, region, CASE WHEN a IS NULL AND b IS NULL THEN 'no_data' WHEN a IS NULL OR b IS NULL THEN 'partial' ELSE 'complete' END AS category, c_custkey % 5 = 0 AS hot FROM {GAPS})))"""


@query("q7_worklist", f"SELECT * FROM {WORK}")
def _(spark, d):
    return W.worklist(gaps(spark, d), "c_custkey", "region", ["a", "b"], F.col("c_custkey") % 5 == 0)


@query("q8_batch", f"SELECT c_custkey, 10 - priority + CAST(hot AS INT) AS score FROM {WORK} ORDER BY score DESC, c_custkey LIMIT 50")
def _(spark, d):
    work = W.worklist(gaps(spark, d), "c_custkey", "region", ["a", "b"], F.col("c_custkey") % 5 == 0)
    return W.batch(work, 50, 10 - F.col("priority") + F.col("hot").cast("int"), "c_custkey").select("c_custkey", "score")


@query("q9_alias_repair", "SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'known' WHEN t.c_custkey IS NOT NULL THEN 'alias_duplicate' WHEN o_custkey % 2 = 0 THEN 'reference_old_name' ELSE 'unknown' END AS kind FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) c ON c.c_custkey = o_custkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) t ON t.c_custkey = o_custkey + 1 AND o_custkey % 2 = 0")
def _(spark, d):
    master = table(spark, d, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    aliases = orders.where("k % 2 = 0").select(F.col("k").alias("source"), (F.col("k") + 1).alias("target")).distinct()
    return W.alias_repair(orders, master, "k", aliases).select("o_orderkey", "kind")


REASONS = f"(SELECT contest, CASE WHEN max(CASE WHEN p.zone IS NOT NULL THEN 1 END) IS NULL THEN 'zone_not_in_panel' WHEN count(returned) = 0 THEN 'value_missing' ELSE 'covered' END AS reason FROM (SELECT contest || '_' || zone AS contest, zone FROM ({LINKS})) LEFT JOIN (SELECT * FROM {PANEL} WHERE survey = 1) p USING (zone) GROUP BY 1)"


def reasons(spark, d):
    pairs = links(spark, d).distinct().select(F.concat_ws("_", "contest", "zone").alias("contest"), "zone")
    return pairs, W.missing_reasons(pairs, pairs, panel(spark, d).where("survey = 1"), "contest", "zone", "returned")


@query("q11_missing_reasons", f"SELECT * FROM {REASONS}")
def _(spark, d):
    return reasons(spark, d)[1]


@query("q12_gap_audit", f"""WITH r AS (SELECT *, split_part(contest, '_', 1) AS region FROM {REASONS})
    SELECT region, count(*) AS contests, count(*) FILTER (reason <> 'covered') AS gaps, (SELECT reason FROM r q WHERE q.region = r.region AND reason <> 'covered' GROUP BY reason ORDER BY count(*) DESC, reason LIMIT 1) AS top_break FROM r GROUP BY region""")
def _(spark, d):
    pairs, found = reasons(spark, d)
    return W.gap_audit(found, pairs.select("contest", F.substring_index("contest", "_", 1).alias("region")), "contest", "region")


@query("q14_catalog_audit", "SELECT DISTINCT p_name AS variable, p_name AS source, bool_or(p_type = 'SMALL') OVER (PARTITION BY p_name) AS in_raw, bool_or(p_type = 'LARGE') OVER (PARTITION BY p_name) AS in_processed FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    columns = part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("column"), F.when(F.col("p_type") == "SMALL", "raw").when(F.col("p_type") == "LARGE", "processed").otherwise("other").alias("stage"))
    return W.catalog_audit(part.select(F.col("p_name").alias("variable"), F.col("p_name").alias("source")).distinct(), columns)


FILL = f"(SELECT contest, variable, sum(value * share) / sum(share) AS value, count(*) AS zones, sum(share) AS mapped FROM {SHARES} JOIN (UNPIVOT (SELECT zone, tax, returned FROM {PANEL} WHERE survey = 1) ON tax, returned INTO NAME variable VALUE value) USING (zone) WHERE variable = 'tax' OR contest < 'F' GROUP BY 1, 2)"


def fill(spark, d):
    targets = links(spark, d).select("contest").distinct().select("contest", F.lit(None).cast("double").alias("tax"), F.when(F.col("contest") >= "F", 1.0).alias("returned"))
    return targets, W.autofill(targets, shares(spark, d), panel(spark, d).where("survey = 1").drop("survey"), "contest", "zone", ["tax", "returned"])


@query("d12_autofill", f"SELECT *, CASE WHEN zones = 1 THEN 'zone_proxy' ELSE 'weighted' END AS method, CASE WHEN mapped >= 0.95 THEN 'high' WHEN mapped >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM {FILL}")
def _(spark, d):
    return fill(spark, d)[1]


@query("d13_skip_diagnostics", f"SELECT contest, CASE WHEN contest < 'F' THEN 2 ELSE 1 END AS missing, count(*) AS filled, 'none' AS action FROM {FILL} GROUP BY 1")
def _(spark, d):
    targets, made = fill(spark, d)
    return W.skip_diagnostics(targets, made, links(spark, d), "contest", ["tax", "returned"])


SMALL_NAMES = "(SELECT p_size AS region, p_name AS name, least(count(*), 4) AS expected, count(*) FILTER (p_retailprice > 1000) AS filled FROM part WHERE p_type = 'SMALL' GROUP BY ALL)"


@query("d13_skipped_targets", f"""WITH t AS (SELECT *, region % 3 > 0 OR name < 'm' AS linked FROM {SMALL_NAMES} WHERE filled < expected), p AS (SELECT DISTINCT p_size AS region, p_name AS name, p_type FROM part),
    c AS (SELECT t.region, t.name, p.name AS b, p.p_type, 1 - levenshtein(t.name, p.name) / greatest(length(t.name), length(p.name)) AS score FROM t JOIN p USING (region) WHERE p_type IN ('LARGE', 'MEDIUM')
        AND (score >= 0.7 OR least(length(t.name), length(b)) >= 5 AND (contains(t.name, b) OR contains(b, t.name) OR substr(t.name, 1, 5) = substr(b, 1, 5)))),
    m AS (SELECT region, name, arg_min(b, {{'s': -score, 'b': b}}) FILTER (p_type = 'LARGE') AS closest_roll, arg_min(b, {{'s': -score, 'b': b}}) FILTER (p_type = 'MEDIUM') AS closest_map FROM c GROUP BY ALL),
    f AS (SELECT t.*, EXISTS (FROM p WHERE p.region = t.region AND p.name = t.name AND p_type = 'PROMO') AS in_master, EXISTS (FROM p WHERE p.region = t.region AND p.name = t.name AND p_type = 'LARGE') AS in_roll, closest_roll, closest_map FROM t LEFT JOIN m ON m.region = t.region AND m.name = t.name),
    a AS (SELECT *, CASE WHEN NOT in_master THEN closest_roll END AS alias, CASE WHEN filled > 0 THEN 'partial' WHEN linked THEN 'no_value' ELSE 'no_link' END AS reason FROM f)
    SELECT region, name, expected, filled, in_master, in_roll, closest_roll, closest_map, alias, reason, CASE WHEN name LIKE 'red%' THEN 'merge_duplicate' WHEN name LIKE 'hot%' THEN 'drop_old_name' WHEN alias IS NOT NULL THEN 'map_alias' WHEN reason = 'no_link' THEN 'add_link' WHEN NOT in_master AND NOT in_roll THEN 'drop_old_name' ELSE 'research' END AS action FROM a""")
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_size").alias("region"), F.col("p_name").alias("name"), "p_type", "p_retailprice")
    of = lambda kind: part.where(F.col("p_type") == kind)
    own = of("SMALL").groupBy("region", "name").agg(F.least(F.count("*"), F.lit(4)).alias("expected"), F.count_if(F.col("p_retailprice") > 1000).alias("filled"))
    kind = F.when(F.col("name").like("red%"), "alias_duplicate").when(F.col("name").like("hot%"), "reference_old_name")
    return W.skipped_targets(own.drop("filled"), own, own.where("region % 3 > 0 or name < 'm'"), {"master": of("PROMO"), "roll": of("LARGE")}, {"roll": of("LARGE"), "map": of("MEDIUM")}, own.withColumn("kind", kind), "region", "master", "roll", 0.7)


@query("d7_region_trends", f"SELECT zone, -(avg(tax) FILTER (survey = 2) - avg(tax) FILTER (survey = 1)) AS tax_trend, avg(returned) FILTER (survey = 2) - avg(returned) FILTER (survey = 1) AS returned_trend FROM {PANEL} GROUP BY 1")
def _(spark, d):
    return W.region_trends(panel(spark, d), "zone", "survey", 1, 2, {"tax": -1, "returned": 1})


@query("d8_mutual_nearest", """WITH l AS (SELECT c_nationkey AS block, c_custkey AS code, c_acctbal AS x FROM customer), r AS (SELECT s_nationkey AS block, s_suppkey AS name, s_acctbal AS x FROM supplier), p AS (SELECT block, code, name, abs(l.x - r.x) AS cost FROM l JOIN r USING (block))
    SELECT block, code, name, cost, CASE WHEN cost < 12 THEN 'high' WHEN cost < 25 THEN 'medium' ELSE 'low' END AS confidence FROM p
    QUALIFY row_number() OVER (PARTITION BY block, code ORDER BY cost, name) = 1 AND row_number() OVER (PARTITION BY block, name ORDER BY cost, code) = 1""")
def _(spark, d):
    l = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("x"))
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("x"))
    return W.mutual_nearest(l, r, "block", ["x"])


@query("d8_mutual_nearest_features", """WITH l AS (SELECT c_nationkey AS block, c_custkey AS code, c_acctbal AS x, sum(o_totalprice) / 1000 AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT s_nationkey AS block, s_suppkey AS name, s_acctbal AS x, sum(l_extendedprice) / 1000 AS y FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
    p AS (SELECT block, code, name, (abs(l.x - r.x) + abs(l.y - r.y)) / 2 AS cost FROM l JOIN r USING (block))
    SELECT block, code, name, cost, CASE WHEN cost < 12 THEN 'high' WHEN cost < 25 THEN 'medium' ELSE 'low' END AS confidence FROM p
    QUALIFY row_number() OVER (PARTITION BY block, code ORDER BY cost, name) = 1 AND row_number() OVER (PARTITION BY block, name ORDER BY cost, code) = 1""")
def _(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg((F.sum("o_totalprice") / 1000).alias("y"))
    sold = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg((F.sum("l_extendedprice") / 1000).alias("y"))
    l = table(spark, d, "customer").select(F.col("c_nationkey").alias("block"), F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("x")).join(spent, "code")
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("x")).join(sold, "name")
    return W.mutual_nearest(l, r, "block", ["x", "y"])
