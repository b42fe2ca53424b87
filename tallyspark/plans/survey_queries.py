"""Registered queries: survey curation over documents, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import surveys as V
from tallyspark.plans import fixtures as X
from tallyspark.plans.fixtures import sql, table
from tallyspark.plans.registry import query


@query("v1_match_label", "SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 'RR' WHEN contains(p_name, 'widget') THEN 'W' WHEN contains(p_name, 'ring') THEN 'R' WHEN contains(p_name, 'red') THEN 'C' END AS canonical FROM part")
def _(spark, d):
    return V.match_label(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", {"red ring": "RR", "ring": "R", "widget": "W", "red": "C"}).select("p_partkey", "canonical")


@query("v2_match_group", "SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'thing' WHEN contains(p_name, 'ring') THEN 'thing' WHEN regexp_matches(p_name, '\\bred\\b') THEN 'colour' END AS group_type, CASE WHEN contains(p_name, 'widget') THEN 'tool' WHEN contains(p_name, 'ring') THEN 'jewel' WHEN regexp_matches(p_name, '\\bred\\b') THEN 'red' END AS \"group\" FROM part")
def _(spark, d):
    groups = {"widget": ("thing", "tool"), "ring": ("thing", "jewel"), "red": ("colour", "red")}
    return V.match_group(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", groups).select("p_partkey", "group_type", "group")


@query("v3_keyword_score", "SELECT doc_id, 2 * CAST(contains(t, 'the ') AS INT) + 3 * CAST(contains(t, 'token') AS INT) + 2 * CAST(contains(t, ' der ') AS INT) AS score, list_filter([CASE WHEN contains(t, ' der ') THEN ' der ' END, CASE WHEN contains(t, 'the ') THEN 'the ' END, CASE WHEN contains(t, 'token') THEN 'token' END], lambda x: x IS NOT NULL) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark, d):
    return V.keyword_score(table(spark, d, "documents"), "text", {"the ": ("en", 2), " der ": ("de", 2), "token": ("secret", 3)}).select("doc_id", "score", "hits")


N = "len(regexp_extract_all(lower(text), '{}'))"


@query("v4_classify_docs", f"SELECT doc_id, CASE WHEN en >= de AND en > 0 AND en > de THEN 'en' WHEN de > 0 THEN 'de' WHEN en > 0 THEN 'en' END AS class, greatest(en, de) AS hits, CASE WHEN contains(lower(text), 'token =') THEN 'skip' WHEN greatest(en, de) >= 8 THEN 'accept' WHEN greatest(en, de) >= 4 THEN 'review' ELSE 'skip' END AS action FROM (SELECT *, {N.format(' the ')} + {N.format(' of ')} AS en, {N.format(' der ')} + {N.format(' und ')} AS de FROM documents)")
def _(spark, d):
    return V.classify_docs(table(spark, d, "documents"), "text", {"en": [" the ", " of "], "de": [" der ", " und "]}, ["token ="]).select("doc_id", "class", "hits", "action")


EVENT = "SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))


@query("v7_validate_rows", f"""WITH e AS ({EVENT}), w AS (SELECT *, CASE WHEN k > 50 THEN event_type ELSE ' ' END AS label, count(*) OVER g AS n, min(value) OVER g AS lo, max(value) OVER g AS hi FROM e WINDOW g AS (PARTITION BY user_id, k))
    SELECT event_id, list_filter([CASE WHEN value > 100 THEN 'range' END, CASE WHEN label = ' ' THEN 'blank_label' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN lo <> hi THEN 'conflict' END], lambda x: x IS NOT NULL) AS flags,
           CASE WHEN value > 100 OR lo <> hi THEN 'error' WHEN label = ' ' OR n > 1 THEN 'warn' ELSE 'ok' END AS status FROM w""")
def _(spark, d):
    rows = events(spark, d).withColumn("label", F.when(F.col("k") > 50, F.col("event_type")).otherwise(" "))
    return V.validate_rows(rows, "value", ["user_id", "k"], ["label"]).select("event_id", "flags", "status")


@query("v8_resolve_reviews", f"SELECT event_id, CASE WHEN d = 'edit' THEN 0 ELSE value END AS value, coalesce(d, 'auto_approve') AS decision FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'edit' WHEN k % 5 = 1 THEN 'reject' WHEN k % 5 = 2 THEN 'approve' END AS d FROM ({EVENT})) WHERE d IN ('edit', 'approve') OR (d IS NULL AND value > 50)")
def _(spark, d):
    rows = events(spark, d)
    reviews = rows.where("k % 5 < 3").select("event_id", F.when(F.col("k") % 5 == 0, "edit").when(F.col("k") % 5 == 1, "reject").otherwise("approve").alias("decision"), F.lit(0.0).alias("new_value"))
    return V.resolve_reviews(rows.withColumn("confidence", F.when(F.col("value") > 50, "high").otherwise("low")), reviews, "event_id", "value").select("event_id", "value", "decision")


@query("v9_curate", f"""WITH u AS (SELECT user_id, k, value, k % 3 AS confidence, 0 AS origin FROM ({EVENT}) WHERE event_type = 'click' UNION ALL SELECT user_id, k, value, k % 3, 1 FROM ({EVENT}) WHERE event_type = 'view')
    SELECT user_id, k, min(origin) AS origin, (array_agg(value ORDER BY origin, confidence DESC, value))[1] AS value, count(DISTINCT value) > 1 AS conflict, CASE WHEN count(DISTINCT value) > 1 THEN 'conflicting' WHEN min(origin) = 0 THEN 'reviewed' ELSE 'extracted' END AS trust FROM u GROUP BY 1, 2""")
def _(spark, d):
    rows = events(spark, d).withColumn("confidence", F.col("k") % 3)
    return V.curate([rows.where("event_type = 'click'"), rows.where("event_type = 'view'")], ["user_id", "k"], "value")


@query("v11_poll_accuracy", sql("grouped ranked option_dim", """, a AS (SELECT region, option, 100 * sum(votes) / sum(sum(votes)) OVER (PARTITION BY region) AS share FROM ranked WHERE period = 2 AND option <> 'Brand#1' GROUP BY region, option), g AS (SELECT region, "group", sum(share) AS share FROM a JOIN option_dim USING (option) GROUP BY ALL),
    s AS (SELECT region, option, avg(vote_share) AS share FROM ranked WHERE period = 1 GROUP BY ALL)
    SELECT s.region, s.option, s.share, coalesce(a.share, g.share) AS actual, s.share - coalesce(a.share, g.share) AS error, abs(s.share - coalesce(a.share, g.share)) AS abs_error, CASE WHEN s.share > coalesce(a.share, g.share) THEN 'over' WHEN s.share < coalesce(a.share, g.share) THEN 'under' ELSE 'exact' END AS direction
    FROM s JOIN option_dim o ON s.option = o.option LEFT JOIN a ON a.region = s.region AND a.option = s.option LEFT JOIN g ON g.region = s.region AND g."group" = o."group" """))
def _(spark, d):
    prev, curr = X.periods(spark, d)
    votes = curr.where("option <> 'Brand#1'").groupBy("region", "option").agg(F.sum("votes").alias("v"))
    totals = votes.groupBy("region").agg(F.sum("v").alias("t"))
    actual = votes.join(totals, "region").select("region", "option", (100 * F.col("v") / F.col("t")).alias("share"))
    return V.poll_accuracy(prev.groupBy("region", "option").agg(F.avg("vote_share").alias("share")), actual, X.option_dim(spark, d))


@query("v12_prioritise", "SELECT event_id, CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS bucket FROM events")
def _(spark, d):
    return V.prioritise(table(spark, d, "events"), "value", 60, 20).select("event_id", "bucket")


@query("v13_extract_facts", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\d+)\.\d+\.\d+\.\d+', 1), ''), nullif(regexp_extract(text, '(\d{4,})', 1), '')) AS number FROM documents")
def _(spark, d):
    return V.extract_facts(table(spark, d, "documents"), "text", {"number": [r"(\d+)\.\d+\.\d+\.\d+", r"(\d{4,})"]}).select("doc_id", "number")


CELLS = r"""lines AS (SELECT doc_id AS file, i - 1 AS row, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    cells AS (SELECT file, row, j - 1 AS col, value FROM (SELECT file, row, unnest(string_split(line, ' ')) AS value, generate_subscripts(string_split(line, ' '), 1) AS j FROM lines))"""


def cells(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    return rows.select("file", "row", F.posexplode(F.split("line", " ", -1)).alias("col", "value"))


@query("io4_header_rows", f"WITH {CELLS}, p AS (SELECT file, row, count(*) FILTER (trim(value) <> '') / count(*) AS share, bool_or(try_cast(trim(value) AS DOUBLE) IS NOT NULL) AS numbers, bool_or(regexp_matches(lower(value), 'the|der')) AS hit FROM cells WHERE row < 15 GROUP BY 1, 2) SELECT file, coalesce(min(row) FILTER (share >= 0.6 AND NOT numbers AND hit), 0) AS row FROM p GROUP BY 1")
def _(spark, d):
    return V.header_rows(cells(spark, d), ["the", "der"])


@query("r7_unpivot_cells", "WITH c AS (SELECT user_id AS file, CAST(k AS INT) AS k, event_id, value FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events)), w AS (SELECT file, k, sum(value) AS s FROM c GROUP BY 1, 2) SELECT file, 'l' || (k // 10) AS label, 'o' || (k % 10) AS option, s AS value FROM w WHERE k >= 10 AND k % 10 > 0")
def _(spark, d):
    sums = events(spark, d).groupBy(F.col("user_id").alias("file"), "k").agg(F.sum("value").alias("s"))
    spots = sums.select("file", F.floor(F.col("k") / 10).cast("int").alias("row"), (F.col("k") % 10).alias("col"), F.col("s").cast("string").alias("value")).where("row > 0 and col > 0")
    files = sums.select("file").distinct()
    head = files.select("file", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("col")).select("*", F.concat(F.lit("o"), "col").alias("value"))
    side = files.select("file", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("row"), F.lit(0).alias("col")).select("*", F.concat(F.lit("l"), "row").alias("value"))
    return V.unpivot_cells(spots.unionByName(head).unionByName(side), files.select("file", F.lit(0).alias("row")))


@query("v6_table_inventory", f"WITH {CELLS} SELECT file, count(*) AS cells, count(*) FILTER (try_cast(trim(value) AS DOUBLE) IS NOT NULL) AS numbers, count(*) FILTER (contains(value, '%')) AS percents, count(*) FILTER (regexp_matches(lower(value), 'the|der')) AS words FROM cells GROUP BY 1")
def _(spark, d):
    return V.table_inventory(cells(spark, d), ["the", "der"])
