"""Registered queries: keyed tables that grow, substring search by an index, a spine joined where it lies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import relational as R
from tallyspark.operators.dataset_report import DatasetReport
from tallyspark.plans.fixtures import table
from tallyspark.plans.registry import query
from tallyspark.sources.shared import new_path, stored_bucketed
from tallyspark.sources.stores import GramIndex, KeyedTable


@query("io10_keyed_append", "SELECT k, kind FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, kind) AS i FROM (SELECT l_partkey AS k, l_returnflag AS kind, 0 AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_linestatus, 1 FROM lineitem WHERE l_returnflag <> 'R')) WHERE i = 1")
def _(spark, d):
    line = table(spark, d, "lineitem")
    store = KeyedTable(spark, new_path(spark, "keyed"), ["k"])
    store.append(line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("kind")), [F.asc("kind")])
    store.append(line.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("k"), F.col("l_linestatus").alias("kind")), [F.asc("kind")])
    return store.read()


@query("p11_indexed_search", "SELECT page_id, url FROM pages WHERE url ILIKE '%thth%' OR url ILIKE '%.org/en/4%'")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    index = GramIndex(spark, new_path(spark, "grams"), "page_id", ["url"])
    index.append(pages)
    return index.search(pages, "THTH").unionByName(index.search(pages, ".org/en/4")).distinct()


SUMS = {"total": "sum(o_totalprice)", "high": "max(o_totalprice)", "low": "min(o_totalprice)", "first": "min(o_orderdate)", "last": "max(o_orderdate)", "done": "count(*) FILTER (WHERE o_orderstatus = 'F')", "open": "count(*) FILTER (WHERE o_orderstatus = 'O')", "kinds": "count(DISTINCT o_orderpriority)"}


@query("j7_spine_lookups", "SELECT c_custkey, c_mktsegment, " + ", ".join(SUMS) + " FROM customer " + " ".join(f"LEFT JOIN (SELECT o_custkey, {s} AS {n} FROM orders GROUP BY 1) AS t_{n} ON t_{n}.o_custkey = c_custkey" for n, s in SUMS.items()))
def _(spark, d):
    """The spine and its eight lookups are written once by key and joined where they lie."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    spine = stored_bucketed(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "spine", ["c_custkey"])
    lookups = [stored_bucketed(orders.groupBy("c_custkey").agg(F.expr(s).alias(n)), f"lookup-{n}", ["c_custkey"]) for n, s in SUMS.items()]
    return R.multi_left_join(spine, [(x.hint("merge"), ["c_custkey"]) for x in lookups])


SPENT = "SELECT c_custkey, c_mktsegment AS region, c_nationkey AS zone, count(*) FILTER (o_orderstatus = 'F') > 0 AS has_old, count(*) FILTER (o_orderstatus = 'O') > 0 AS has_new, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'high' END AS quality, count(o_orderkey) / 10 AS coverage, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS old_sum, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS new_sum, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS open_sum FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey, c_acctbal"


@query("a24_dataset_report", f"""WITH r AS ({SPENT}), m AS (SELECT count(*) AS rows, count(*) FILTER (has_old <> has_new) AS one, count(*) FILTER (coverage < 0.85) AS low, count(*) - count(old_sum) AS old_sum, count(*) - count(new_sum) AS new_sum, count(*) - count(open_sum) AS open_sum FROM r),
    t AS (SELECT string_agg(f || '=' || CAST(floor(100 * n / rows + 0.5) AS BIGINT) || '%', ', ' ORDER BY n DESC, f) AS missing FROM (UNPIVOT m ON old_sum, new_sum, open_sum INTO NAME f VALUE n))
    SELECT 'customers' AS dataset, count(*) AS rows, count(DISTINCT region) AS regions, count(DISTINCT (region, zone)) AS zones, count(*) FILTER (has_old AND has_new) AS both_rounds, count(*) FILTER (quality = 'low') AS low_quality,
           (SELECT CASE WHEN one > 0 THEN one || ' rows of one round only; ' ELSE '' END || CASE WHEN low > 0 THEN low || ' rows with a coverage below 0.85; ' ELSE '' END || 'most missing: ' || missing FROM m, t) AS notes FROM r""")
def _(spark, d):
    """Customers in two files, by the sign of their balance; the second is added without reading the first again."""
    orders, status = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), F.col("o_orderstatus")
    of = lambda s: F.when(status == s, F.col("o_totalprice"))
    sums = orders.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(of("F")).alias("old_sum"), F.sum(of("O")).alias("new_sum"), F.sum(of("P")).alias("open_sum"), F.bool_or(status == "F").alias("has_old"), F.bool_or(status == "O").alias("has_new"))
    low = F.col("c_acctbal") < 0
    rows = table(spark, d, "customer").join(sums, "c_custkey", "left").select("c_acctbal", F.col("c_mktsegment").alias("region"), F.col("c_nationkey").alias("zone"), "has_old", "has_new", F.when(low, "low").otherwise("high").alias("quality"), (F.coalesce("n", F.lit(0)) / 10).alias("coverage"), "old_sum", "new_sum", "open_sum")
    report = DatasetReport(spark, new_path(spark, "report"), {"regions": ["region"], "zones": ["region", "zone"]}, ["old_sum", "new_sum", "open_sum"])
    report.add("low", rows.where(low))
    report.add("high", rows.where(~F.coalesce(low, F.lit(False))))
    return report.report("customers")
