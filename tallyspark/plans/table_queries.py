"""Registered queries: survey tables of every layout, their potential and priority, progress by contest and by variable, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import relational as R
from tallyspark.operators import survey_cells as L
from tallyspark.operators import surveys as V
from tallyspark.operators import worklists as W
from tallyspark.plans.fixtures import table
from tallyspark.plans.registry import query
from tallyspark.plans.source_queries import GAPS, gaps
from tallyspark.sources.shared import stored

ALIASES = {f"Brand {k}": f"B{k}" for k in range(10)}
GROUPS = {f"Zone {k}": ("zone", f"Z{k}") for k in range(10)}

SUMS = """s AS (SELECT user_id AS file, user_id % 5 AS kind, CAST(k AS INT) // 10 AS g, CAST(k AS INT) % 10 AS o, round(least(max(value), 99), 2) + 1 AS share
    FROM (SELECT user_id, value, regexp_extract(props, '(\\d+)', 1) AS k FROM events) GROUP BY ALL)"""


def survey_cells(spark, d):
    """Cells of one table for each user, in the layout of the user's number: groups in rows, options in rows, marginal, groups in
    rows under a title row, long."""
    e = table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    s = e.groupBy(F.col("user_id").alias("file"), "k").agg((F.round(F.least(F.max("value"), F.lit(99.0)), 2) + 1).cast("string").alias("value"))
    s = s.withColumns({"kind": F.col("file") % 5, "g": F.floor(F.col("k") / 10).cast("int"), "o": F.col("k") % 10})
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))
    g, o, k, n = F.col("g"), F.col("o"), F.col("k"), F.lit
    zone, brand, down = F.concat(n("Zone "), g), F.concat(n("Brand "), o), (F.col("kind") == 3).cast("int")
    crossed = F.array(cell(g + 1 + down, o + 1, F.col("value")), cell(g + 1 + down, n(0), zone))
    turned = F.array(cell(o + 1, g + 1, F.col("value")), cell(o + 1, n(0), brand))
    marginal = F.array(cell(k + 1, n(0), brand), cell(k + 1, n(1), k), cell(k + 1, n(2), F.col("value")))
    long = F.array(cell(k + 1, n(0), zone), cell(k + 1, n(1), brand), cell(k + 1, n(2), F.col("value")))
    body = s.select("file", F.explode(F.when(F.col("kind").isin(0, 3), crossed).when(F.col("kind") == 1, turned).when(F.col("kind") == 2, marginal).otherwise(long)).alias("x"))
    digits = F.sequence(n(0), n(9))
    heads = lambda row, word: F.transform(digits, lambda j: cell(row, j + 1, F.concat(n(word), j)))
    head = F.when(F.col("kind") == 0, heads(n(0), "Brand ")).when(F.col("kind") == 1, heads(n(0), "Zone ")).when(F.col("kind") == 2, F.array(cell(n(0), n(0), n("label")), cell(n(0), n(1), n("N")), cell(n(0), n(2), n("Share %"))))
    head = head.when(F.col("kind") == 3, F.concat(heads(n(1), "Brand "), F.array(cell(n(0), n(0), n("Title"))))).otherwise(F.array(cell(n(0), n(0), n("group")), cell(n(0), n(1), n("party")), cell(n(0), n(2), n("share"))))
    tops = s.select("file", "kind").distinct().select("file", F.explode(head).alias("x"))
    sides = s.select("file", "kind").distinct().where("kind in (0, 1, 3)").select("file", F.explode(F.transform(digits, lambda j: cell(j + 1 + down, n(0), F.concat(F.when(F.col("kind") == 1, "Brand ").otherwise("Zone "), j)))).alias("x"))
    cells = stored(body.unionByName(tops).unionByName(sides).select("file", "x.*").distinct(), "cells")
    return cells, cells.select("file").distinct().withColumn("row", n(0))


@query("r7_table_layouts", f"WITH {SUMS} SELECT file, CASE WHEN kind = 2 AND count(*) = 1 THEN 'unknown' WHEN kind = 1 THEN 'options_in_rows' WHEN kind = 2 THEN 'marginal' WHEN kind = 4 THEN 'long' ELSE 'groups_in_rows' END AS layout FROM s GROUP BY file, kind")
def _(spark, d):
    cells, heads = survey_cells(spark, d)
    return L.table_layouts(L.file_cells(cells, heads, ALIASES, GROUPS)).select("file", "layout")


@query("v5_extract_cells", f"""WITH {SUMS}, f AS (SELECT *, count(*) OVER (PARTITION BY file) AS n, file % 2 = 1 AS neg, file % 4 = 0 OR file % 7 = 0 AS q, file % 3 > 0 OR file % 4 = 0 OR file % 7 = 0 AS pos FROM s)
    SELECT DISTINCT file, CASE kind WHEN 1 THEN 'options_in_rows' WHEN 2 THEN 'marginal' WHEN 4 THEN 'long' ELSE 'groups_in_rows' END AS layout, CASE kind WHEN 2 THEN 'electorate' ELSE 'zone' END AS group_type, CASE kind WHEN 2 THEN 'all voters' ELSE 'Z' || g END AS "group", 'B' || o AS option, CASE WHEN share <= 1 THEN 100 * share ELSE share END AS share,
           CASE WHEN neg AND NOT pos THEN 'low' WHEN pos AND (kind <> 4 OR n > 1) THEN CASE WHEN kind = 2 OR neg THEN 'medium' ELSE 'high' END WHEN pos OR kind <> 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM f WHERE (kind <> 2 OR n > 1) AND NOT (neg AND NOT q)""")
def _(spark, d):
    cells, heads = survey_cells(spark, d)
    f = F.col("file")
    signals = heads.select("file", F.when(f % 3 > 0, 1).otherwise(0).alias("positive"), (f % 2 * 2).alias("negative"), ((f % 4 == 0) | (f % 7 == 0)).alias("question"))
    rows = L.extract_cells(L.file_cells(cells, heads, ALIASES, GROUPS), signals)
    return rows.select("file", "layout", "group_type", "group", "option", "share", "confidence").distinct()


@query("v12_prioritise_tables", """SELECT source, score, CASE WHEN score >= 4 AND low <= 2 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS bucket, suggested FROM (
    SELECT source, 2 * the + of_ + und + 2 * token AS score, license + mark + der AS low, CASE WHEN der + und > 0 THEN 'de' WHEN the > 0 THEN 'en' ELSE 'unclear' END AS suggested FROM (
    SELECT source, max(CAST(contains(lower(coalesce(text, '')), ' der ') AS INT)) AS der, max(CAST(contains(lower(coalesce(text, '')), 'the ') AS INT)) AS the, max(CAST(contains(lower(coalesce(text, '')), ' of ') AS INT)) AS of_, max(CAST(contains(lower(coalesce(text, '')), ' und ') AS INT)) AS und, max(CAST(contains(lower(coalesce(text, '')), 'token') AS INT)) AS token, max(CAST(contains(lower(coalesce(text, '')), 'license') AS INT)) AS license, max(CAST(contains(lower(coalesce(text, '')), '@') AS INT)) AS mark FROM documents GROUP BY 1))""")
def _(spark, d):
    types = {"de": [" der ", " und "], "en": ["the "]}
    return L.prioritise_tables(table(spark, d, "documents"), "source", "text", ["the ", " of ", " und ", "token"], ["the ", "token"], ["license", "@", " der "], types)


@query("v6_table_potential", f"""WITH {SUMS}, p AS (SELECT file, min(kind) AS kind, count(*) AS n, count(DISTINCT o) AS os, count(DISTINCT g) AS gs FROM s GROUP BY 1),
    c AS (SELECT file, CASE WHEN kind IN (0, 1, 3) THEN 10 ELSE os END AS options, CASE kind WHEN 2 THEN 0 WHEN 4 THEN gs ELSE 10 END AS groups, CASE kind WHEN 2 THEN 2 * n ELSE n END AS cells, kind = 4 OR (kind = 2 AND n = 1) AS shapeless FROM p)
    SELECT file, options, groups, cells AS numbers, cells AS percents, round(greatest(0, least(options, 6) * 4 + least(groups, 6) * 3 + CASE WHEN shapeless THEN 0 ELSE 12 END + CASE WHEN file % 3 = 0 THEN 15 WHEN file % 3 = 1 THEN -20 ELSE 0 END + least(cells, 30) * 0.4 + least(cells, 40) * 0.05), 2) AS potential
    FROM c""")
def _(spark, d):
    cells, heads = survey_cells(spark, d)
    kinds = heads.select("file", F.when(F.col("file") % 3 == 0, "votes").when(F.col("file") % 3 == 1, "method").alias("kind"))
    return L.table_potential(L.file_cells(cells, heads, ALIASES, GROUPS), kinds, ["votes"], ["method"]).select("file", "options", "groups", "numbers", "percents", "potential")


MARKED = "len(regexp_extract_all(lower(text), '{}'))"


@query("v4_classify_in_context", f"""SELECT doc_id, CASE WHEN en > 0 AND en > de THEN 'en' WHEN de > 0 THEN 'de' END AS class, greatest(en, de) AS hits, CASE WHEN greatest(en, de) >= 8 THEN 'accept' WHEN greatest(en, de) >= 4 THEN 'review' ELSE 'skip' END AS action FROM (
    SELECT doc_id, CASE WHEN e > 0 AND contains(lower(text), ' is ') THEN e + 2 ELSE e END AS en, d AS de FROM (SELECT doc_id, text, {MARKED.format(' the ')} AS e, {MARKED.format(' der ')} AS d FROM documents))""")
def _(spark, d):
    return V.classify_docs(table(spark, d, "documents"), "text", {"en": [" the "], "de": [" der "]}, context={"en": ([" is "], 2)}).select("doc_id", "class", "hits", "action")


ENTERED = "(SELECT o_custkey AS c_custkey, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS variable, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' END AS confidence, o_orderstatus <> 'P' AS valid FROM orders)"


def entered(spark, d):
    o, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(o == "F", "a").otherwise("b").alias("variable"), F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").alias("confidence"), (o != "P").alias("valid"))


BY_CONTEST = f"""(SELECT c_custkey, n AS manual_fields, CAST(ha AS INT) + CAST(hb AS INT) AS completed, CASE WHEN ha AND hb THEN '' WHEN ha THEN 'b' WHEN hb THEN 'a' ELSE 'a;b' END AS missing,
        CASE WHEN high > 0 AND medium > 0 THEN 'high:' || high || ', medium:' || medium WHEN high > 0 THEN 'high:' || high WHEN medium > 0 THEN 'medium:' || medium ELSE '' END AS confidence, odd > 0 AS needs_review
    FROM (SELECT g.c_custkey, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(odd, 0) AS odd, a IS NOT NULL OR coalesce(ma, 0) > 0 AS ha, b IS NOT NULL OR coalesce(mb, 0) > 0 AS hb
          FROM {GAPS} g LEFT JOIN (SELECT c_custkey, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (NOT valid) AS odd, count(*) FILTER (variable = 'a') AS ma, count(*) FILTER (variable = 'b') AS mb FROM {ENTERED} GROUP BY 1) m USING (c_custkey)))"""


@query("q6_contest_progress", f"SELECT * FROM {BY_CONTEST}")
def _(spark, d):
    return W.contest_progress(gaps(spark, d), entered(spark, d), "c_custkey", ["a", "b"])


@query("q6_variable_progress", f"""SELECT variable, needed, satisfied, entered, valid, 100 * satisfied / needed AS pct FROM (SELECT 'a' AS variable, count(*) AS needed, count(*) FILTER (missing NOT IN ('a', 'a;b')) AS satisfied, (SELECT count(*) FROM {ENTERED} WHERE variable = 'a') AS entered, (SELECT count(*) FROM {ENTERED} WHERE variable = 'a' AND valid) AS valid FROM {BY_CONTEST}
    UNION ALL SELECT 'b', count(*), count(*) FILTER (missing NOT IN ('b', 'a;b')), (SELECT count(*) FROM {ENTERED} WHERE variable = 'b'), (SELECT count(*) FROM {ENTERED} WHERE variable = 'b' AND valid) FROM {BY_CONTEST})""")
def _(spark, d):
    manual = entered(spark, d)
    return W.variable_progress(W.contest_progress(gaps(spark, d), manual, "c_custkey", ["a", "b"]), manual, ["a", "b"])


@query("q8_expand_batch", f"SELECT c_custkey, unnest(string_split(missing, ';')) AS variable FROM {BY_CONTEST} WHERE missing <> ''")
def _(spark, d):
    manual = entered(spark, d)
    return W.expand_batch(W.contest_progress(gaps(spark, d), manual, "c_custkey", ["a", "b"]), manual, "c_custkey", "missing")


@query("j12_layered_fuzzy", """WITH l AS (SELECT DISTINCT p_type AS block, p_size AS ln, p_name AS left_name FROM part WHERE p_brand = 'Brand#1'), r AS (SELECT DISTINCT p_type AS block, p_size + 100 AS rn, p_name || 's' AS right_name FROM part WHERE p_brand = 'Brand#2'),
    p AS (SELECT l.*, right_name, CASE WHEN ln = rn THEN 1 WHEN upper(left_name) = upper(right_name) THEN 2 WHEN contains(' ' || upper(right_name) || ' ', ' ' || upper(left_name) || ' ') THEN 3 WHEN starts_with(upper(right_name), upper(left_name)) THEN 4 END AS layer,
          1 - levenshtein(left_name, right_name) / greatest(length(left_name), length(right_name)) AS score FROM l JOIN r USING (block)),
    c AS (SELECT block, ln, left_name, layer, count(DISTINCT right_name) AS n, min(right_name) AS right_name FROM p WHERE layer IS NOT NULL GROUP BY ALL),
    u AS (SELECT * FROM c WHERE layer <= 2 OR n = 1 QUALIFY row_number() OVER (PARTITION BY block, ln, left_name ORDER BY layer, right_name) = 1),
    z AS (SELECT block, left_name, min(right_name) AS right_name FROM (SELECT DISTINCT block, left_name, right_name FROM p WHERE score >= 0.8) GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT l.block, l.ln AS number, l.left_name AS name, coalesce(u.right_name, z.right_name) AS right_name, CASE WHEN layer = 3 THEN 'contained' WHEN layer = 4 THEN 'prefix' WHEN z.right_name IS NOT NULL THEN 'fuzzy' END AS method
    FROM l LEFT JOIN u ON l.block = u.block AND l.ln = u.ln AND l.left_name = u.left_name LEFT JOIN z ON l.block = z.block AND l.left_name = z.left_name""")
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_type").alias("block"), F.col("p_size").alias("number"), F.col("p_name").alias("name"), "p_brand")
    right = part.where("p_brand = 'Brand#2'").select("block", (F.col("number") + 100).alias("number"), F.concat("name", F.lit("s")).alias("name"))
    return R.layered_match(part.where("p_brand = 'Brand#1'"), right, "block", fuzzy=0.8).select("block", "number", "name", "right_name", "method")
