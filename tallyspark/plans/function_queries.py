"""Registered queries for the column functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.plans.fixtures import table
from tallyspark.plans.registry import query

ALIAS = {"ECONOMY": "ECO", "STANDARD": "STD"}


@query("s1_squash_ws", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squashed FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.squash_ws(F.col("text")).alias("squashed"))


@query("s2_to_number", "SELECT o_orderkey, try_cast(replace(CAST(o_custkey AS VARCHAR) || ',' || substr(o_orderpriority, 1, 1) || CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END, ',', '') AS DOUBLE) AS number FROM orders")
def _(spark, d):
    text = F.concat(F.col("o_custkey").cast("string"), F.lit(","), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderstatus") == "P", "x").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", S.to_number(text).alias("number"))


@query("s3_contest_id", "SELECT p_partkey, replace(upper(trim(p_type)), ' ', '_') || '__' || replace(upper(trim(p_name)), ' ', '_') AS id FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.contest_id(F.col("p_type"), F.col("p_name")).alias("id"))


@query("s4_slug", "SELECT c_custkey, trim(regexp_replace(upper(c_name || ' - ' || c_mktsegment || '!'), '[^A-Z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.slug(F.concat_ws(" - ", "c_name", F.concat("c_mktsegment", F.lit("!")))).alias("slug"))


@query("s5_normalise_party", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'ECO' WHEN 'STANDARD' THEN 'STD' ELSE p_type END AS by_type,
    CASE WHEN length(p_name) <= 15 AND NOT contains(p_name, ' ') THEN p_name ELSE 'PARTY_' || substr(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 40) END AS by_name FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalise_party(F.col("p_type"), ALIAS).alias("by_type"), S.normalise_party(F.col("p_name"), ALIAS).alias("by_name"))


@query("s6_candidate_id", "SELECT p_partkey, 'CAND_' || p_size || '_' || p_type || '_' || upper(replace(p_name, ' ', '_')) || '_' || upper(replace(p_brand, '#', '_')) || '_' || p_partkey AS id FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.candidate_id(F.col("p_size"), F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_partkey").cast("string")).alias("id"))


@query("s7_region_key", "SELECT n_nationkey, CASE WHEN k = 'NATION_1 & CO' THEN 'FIRST' ELSE k END AS key FROM (SELECT n_nationkey, replace(upper(trim(n_name || ' and  co')), ' AND  ', ' & ') AS k FROM nation)")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.region_key(F.concat("n_name", F.lit(" and  co")), {"NATION_1 & CO": "FIRST"}).alias("key"))


@query("s8_contest_key", "SELECT s_suppkey, 'NO ' || replace(upper(s_name), '#', ' ') AS key FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.contest_key(F.concat(F.lit("no. "), "s_name", F.lit(" (SC)"))).alias("key"))


@query("s9_norm_key", "SELECT p_partkey, upper(p_name) || ' AND ' || p_type AS key, upper(p_name) || '&' || p_type || '-(SC)' AS plain FROM part")
def _(spark, d):
    c = F.concat("p_name", F.lit("&"), "p_type", F.lit("-(SC)"))
    return table(spark, d, "part").select("p_partkey", S.norm_key(c).alias("key"), S.norm_key(c, False, False, False).alias("plain"))


@query("s10_strip_reference_suffix", "SELECT c_custkey, c_mktsegment AS a, c_mktsegment AS b, c_mktsegment AS c FROM customer")
def _(spark, d):
    m = F.col("c_mktsegment")
    f = S.strip_reference_suffix
    return table(spark, d, "customer").select("c_custkey", f(F.concat(m, F.lit(" (old)"))).alias("a"), f(F.concat(m, F.lit(", 12-North"))).alias("b"), f(F.concat(m, F.lit(" 7-South"))).alias("c"))


@query("s11_short_name", r"SELECT p_partkey, trim(regexp_extract(p_type || ' Part of ' || p_name, '^([A-Z]+) ', 1)) AS short FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.short_name(F.concat("p_type", F.lit(" Part of "), "p_name")).alias("short"))


@query("s12_null_tokens", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS token, CASE o_orderstatus WHEN 'F' THEN false ELSE NULL END AS flag FROM orders")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", " N/A ").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.null_tokens(status).alias("token"), S.parse_bool(F.col("o_orderstatus")).alias("flag"))


@query("s13_round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_quantity AS DECIMAL(12, 2)) / 4, 1) AS DOUBLE) AS rounded FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") / 4, 1).alias("rounded"))


@query("s14_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount / l_tax * 100 END AS pct FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.ratio(F.col("l_discount"), F.col("l_tax")).alias("pct"))


@query("s15_clamp", "SELECT event_id, CASE WHEN value < 5 THEN 5 WHEN value > 100 THEN 100 ELSE value END AS value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.clamp(F.col("value"), 5.0, 100.0).alias("value"))


@query("s16_parse_percent", """SELECT event_id, CASE WHEN value BETWEEN 0 AND 100 THEN value END AS strict, CASE WHEN k = 1 THEN 100 WHEN k <= 100 THEN k END::DOUBLE AS loose,
    CASE WHEN f > 0 AND f <= 1 THEN f * 100 WHEN f BETWEEN 0 AND 100 THEN f END AS scaled FROM (SELECT *, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, value / 100 AS f FROM events)""")
def _(spark, d):
    k, text = F.regexp_extract("props", r"(\d+)", 1), lambda c: c.cast("string")
    cells = {"strict": F.concat(text(F.col("value")), F.lit("%")), "loose": F.concat(k, F.lit(" per cent (n=500)")), "scaled": text(F.col("value") / 100)}
    return table(spark, d, "events").select("event_id", *[S.parse_percent(c, loose=n == "loose").alias(n) for n, c in cells.items()])


@query("s17_rank_label", "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 0 END AS rank FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.rank_label(F.substring("o_orderpriority", 3, 20)).alias("rank"))


@query("s18_title_label", "SELECT p_partkey, substr(p_type, 1, 1) || lower(substr(p_type, 2)) AS label, lpad(CAST(p_size AS VARCHAR), 4, '0') AS code FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.title_label(F.col("p_type")).alias("label"), S.pad_code(F.concat(F.col("p_size").cast("string"), F.lit(".0")), 4).alias("code"))


@query("s19_split_list", "SELECT p_partkey, string_split(p_name, ' ') AS items, replace(p_name, ' ', '; ') AS joined FROM part")
def _(spark, d):
    items = S.split_list(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" ; ")), F.lit(";")))
    return table(spark, d, "part").select("p_partkey", items.alias("items"), S.join_list(items).alias("joined"))


@query("s20_share_map", """SELECT l_orderkey, l_linenumber, 100 * (l_quantity + 5) / (l_quantity + 5 + l_tax) AS a, 100 * l_tax / (l_quantity + 5 + l_tax) AS b FROM lineitem""")
def _(spark, d):
    m = S.map_rescale(S.map_add(F.create_map(F.lit("a"), F.col("l_quantity"), F.lit("b"), F.col("l_tax")), F.lit("a"), F.lit(5.0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m["a"].alias("a"), m["b"].alias("b"))


@query("s21_anonymise_id", "SELECT c_custkey, substr(sha256('pepper:' || c_custkey), 1, 12) AS anon FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.anonymise_id(F.col("c_custkey"), "pepper").alias("anon"))


@query("s22_template_text", "SELECT o_orderkey, concat_ws(' ', 'Order of ' || o_orderstatus || '.', CASE WHEN o_custkey > 500 THEN 'Late customer.' END) AS text FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.template_text(F.concat(F.lit("Order of "), "o_orderstatus", F.lit(".")), F.when(F.col("o_custkey") > 500, "Late customer.")).alias("text"))


@query("s23_births_within", "SELECT l_orderkey, l_linenumber, CAST(l_quantity - l_linenumber AS BIGINT) AS months, CAST(l_quantity - l_linenumber BETWEEN 0 AND 36 AS INT) + 1 AS births FROM lineitem")
def _(spark, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.months_between(q, n).alias("months"), S.births_within(q, F.array(n, q)).alias("births"))


@query("s24_weight_scale", "SELECT o_orderkey, o_totalprice / CASE WHEN (SELECT max(o_totalprice) FROM orders) > 1000 THEN 1e6 ELSE 1 END AS o_totalprice FROM orders")
def _(spark, d):
    return S.weight_scale(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("s25_label_by_thresholds", "SELECT event_id, CASE WHEN value >= 75 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 1 THEN 'low' ELSE 'none' END AS band, CASE WHEN value - 20 > 5 THEN 'positive' WHEN value - 20 < -5 THEN 'negative' ELSE 'near_zero' END AS sign FROM events")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", S.label_by_thresholds(v, [(75, "high"), (50, "medium"), (1, "low")], "none").alias("band"), S.sign_label(v - 20, 5).alias("sign"))
