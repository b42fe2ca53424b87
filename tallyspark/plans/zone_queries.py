"""Registered queries: zones and their gaps, areas and composition, the master with turnout, profile sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import contest as C
from tallyspark.operators import profiles as P
from tallyspark.operators import worklists as W
from tallyspark.plans.contest_queries import KEY, PIVOT, pairs, scores
from tallyspark.plans.detail_queries import NEEDED, ROWS, profile_rows
from tallyspark.plans import fixtures as X
from tallyspark.plans.fixtures import sql, table
from tallyspark.plans.registry import query
from tallyspark.plans.summary_queries import PANEL, panel
from tallyspark.sources.shared import stored

ZONES = f"""WITH p AS (SELECT zone, max(CASE WHEN returned IS NOT NULL THEN 1 ELSE 0 END) AS has FROM {PANEL} WHERE survey = 1 GROUP BY 1),
    a AS (SELECT x.n_name AS source, y.n_name AS target FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1 WHERE x.n_regionkey < 2),
    l AS (SELECT n_regionkey AS region, n_name AS zone, count(DISTINCT c_mktsegment) AS contests FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    g AS (SELECT l.*, target, CASE WHEN o.has = 1 THEN 'covered' WHEN t.has = 1 THEN 'alias_missing' WHEN o.has = 0 OR t.has = 0 THEN 'value_missing' ELSE 'zone_not_in_panel' END AS reason
          FROM l LEFT JOIN p o USING (zone) LEFT JOIN a ON source = l.zone LEFT JOIN p t ON t.zone = target) """


def zone_gaps(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    rows = table(spark, d, "customer").join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    after = nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("target"))
    aliases = nation.where("region < 2").select("n_nationkey", F.col("n_name").alias("source")).join(after, "n_nationkey")
    links = rows.select(F.col("c_mktsegment").alias("contest"), "region", F.col("n_name").alias("zone"))
    return W.zone_gaps(links, panel(spark, d).where("survey = 1"), aliases, "region", "zone", "contest", ["returned"])


@query("q12_zone_gaps", ZONES + "SELECT region, zone, contests, reason, CASE reason WHEN 'alias_missing' THEN 'read as ' || target WHEN 'value_missing' THEN 'enter the values' WHEN 'zone_not_in_panel' THEN 'add the zone or an alias of it' ELSE 'none' END AS repair FROM g")
def _(spark, d):
    return zone_gaps(spark, d)


@query("q12_zone_audit", ZONES + "SELECT region, count(*) AS contests, count(*) FILTER (reason <> 'covered') AS gaps, (SELECT reason FROM g q WHERE q.region = g.region AND reason <> 'covered' GROUP BY reason ORDER BY count(*) DESC, reason LIMIT 1) AS top_break FROM g GROUP BY region")
def _(spark, d):
    found = zone_gaps(spark, d)
    return W.gap_audit(found.select("zone", "reason"), found.select("zone", "region"), "zone", "region")


MOVED = "(CASE WHEN c_acctbal < 0 THEN 'MOVED' ELSE c_mktsegment END)"


def moves(spark, d):
    return table(spark, d, "customer").where("c_acctbal < 0").select(F.upper("c_mktsegment").alias("region_key"), F.upper("c_name").alias("zone_key"), F.lit("MOVED").alias("new_region"))


@query("d10_zone_areas", f"""SELECT upper(region) AS region_key, upper(zone) AS zone_key, region, zone, CASE WHEN a > 0 THEN a ELSE b END AS area, CASE WHEN a > 0 THEN 0 ELSE 1 END AS source
    FROM (SELECT {MOVED} AS region, c_name AS zone, any_value(c_acctbal) AS a, min(o_totalprice) FILTER (o_totalprice > 0) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE a > 0 OR b > 0""")
def _(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("region"), F.col("c_name").alias("zone"), F.col("c_acctbal").alias("area"))
    second = own.drop("area").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("area")), "c_custkey")
    return P.zone_areas([own, second], "region", "zone", "area", moves(spark, d))


@query("d10_zone_composition", f"""WITH r AS (SELECT {MOVED} AS region, c_name AS zone, o_totalprice AS total, o_totalprice / 4 AS x, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 8 END AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice <= 300000 AND c_custkey > 0)
    SELECT upper(region) AS region_key, upper(zone) AS zone_key, region, zone, total, x, y, 100 * x / total AS x_pct, 100 * y / total AS y_pct FROM (SELECT *, row_number() OVER (PARTITION BY region, zone ORDER BY total) AS n FROM r) WHERE n = 1""")
def _(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("region"), F.col("c_name").alias("zone"))
    price = F.col("o_totalprice")
    raw = table(spark, d, "orders").join(customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(
        "c_nationkey", F.col("o_custkey").alias("c_custkey"), F.when(price > 300000, "12").otherwise("00000").alias("part"), F.when(F.col("o_orderstatus") == "F", " Total").otherwise("Rural").alias("kind"),
        price.alias("total"), (price / 4).alias("x"), F.when(price > 100000, price / 8).alias("y"),
    )
    return P.zone_composition(raw, customer, "c_nationkey", "c_custkey", ["part"], "kind", "total", ["x", "y"], "region", "zone", (2, 9), moves(spark, d))


@query("c6_master_turnout", sql("compared features swings", f"""SELECT c.*, p.top2_margin_pct AS prev_margin, p.effective_options AS prev_effective, f.top2_margin_pct AS curr_margin, f.effective_options AS curr_effective,
    f.top2_margin_pct - p.top2_margin_pct AS margin_change, v.* EXCLUDE (contest), t.turnout AS prev_turnout, u.turnout AS curr_turnout, u.turnout - t.turnout AS turnout_change, s.balance FROM compared c
    LEFT JOIN (SELECT * FROM features WHERE period = 1) p USING (contest) LEFT JOIN (SELECT * FROM features WHERE period = 2) f USING (contest)
    LEFT JOIN (SELECT contest, {PIVOT} FROM swings GROUP BY contest) v USING (contest)
    LEFT JOIN (SELECT contest, votes / vote_share AS turnout FROM ranked WHERE winner AND period = 1) t USING (contest) LEFT JOIN (SELECT contest, votes / vote_share AS turnout FROM ranked WHERE winner AND period = 2) u USING (contest)
    LEFT JOIN (SELECT n_name, avg(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s ON s.n_name = c.region"""))
def _(spark, d):
    prev, curr = X.periods(spark, d)
    found = stored(pairs(spark, d, KEY), "pairs")
    turnouts = tuple(C.winner_turnout(rows.withColumn("turnout", F.col("votes") / F.col("vote_share")), "turnout") for rows in (prev, curr))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    balance = table(spark, d, "supplier").join(nation, "s_nationkey").groupBy("region").agg(F.avg("s_acctbal").alias("balance"))
    features = C.features_of(found, "curr").select("contest", "region").join(balance, "region").select("contest", "balance")
    return C.master_of(found, KEY, turnouts, features)


def moved_sql(o: str) -> str:
    s = f"swing_{o}"
    return f"CASE WHEN abs({s}) >= 0.5 THEN '{o} ' || CASE WHEN {s} > 0 THEN 'gains ' ELSE 'loses ' END || CAST(CAST(floor(abs({s}) + 0.5) AS BIGINT) AS VARCHAR) || ' points.' WHEN {s} IS NOT NULL THEN '{o} holds its share.' END"


FACTS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in ("prev_winner", "curr_winner", "margin", "swing_a", "swing_b", "turnout_prev", "turnout_curr", "urban", "coverage", "zones_missing"))


@query("c10_profile_sections", sql(NEEDED, ROWS + f"""SELECT r.contest, CASE WHEN r.flipped THEN r.region || ': from ' || prev_winner || ' to ' || curr_winner || '.' ELSE r.region || ': held by ' || curr_winner || '.' END AS summary,
    coalesce(nullif(concat_ws(' ', {moved_sql('a')}, {moved_sql('b')}, CASE WHEN turnout_curr > turnout_prev THEN 'Turnout rises.' WHEN turnout_curr < turnout_prev THEN 'Turnout falls.' WHEN turnout_curr = turnout_prev THEN 'Turnout is unchanged.' END), ''), 'No change is known.') AS movement,
    CASE WHEN urban >= 50 THEN 'Mostly urban.' WHEN urban < 30 THEN 'Mostly rural.' WHEN urban IS NOT NULL THEN 'Town and country.' ELSE 'No area data.' END AS population,
    concat_ws(' ', coalesce('Zones cover ' || CAST(CAST(floor(100 * coverage + 0.5) AS BIGINT) AS VARCHAR) || ' percent.', 'No zone is linked.'), CASE WHEN zones_missing <> '' THEN 'Without data: ' || zones_missing || '.' END) AS zones,
    coalesce(nullif(concat_ws(' ', CASE WHEN margin <= 5 THEN 'The margin is ' || CAST(CAST(floor(margin + 0.5) AS BIGINT) AS VARCHAR) || ' points.' END, CASE WHEN r.flipped THEN 'The seat is new to its holder.' END, CASE WHEN abs(turnout_curr - turnout_prev) >= 5 THEN 'Turnout moves.' END), ''), 'Nothing stands out.') AS watch,
    CASE WHEN curr_winner IS NULL OR margin IS NULL OR swing_a IS NULL OR swing_b IS NULL THEN 'low' WHEN quality = 'high' THEN 'high' ELSE 'medium' END AS confidence, quality, concat_ws(';', {FACTS}) AS facts
    FROM rows r JOIN (SELECT contest, prev_winner, curr_winner FROM volatility) USING (contest)"""))
def _(spark, d):
    return P.profile_sections(profile_rows(spark, d).join(scores(spark, d).select("contest", "prev_winner", "curr_winner"), "contest"))


@query("d8_code_crosswalk", """WITH c AS (SELECT p_type AS region, 2 * p_size AS code, avg(p_retailprice) AS x FROM part GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY z, name) AS code FROM (SELECT p_type AS region, p_name AS name, min(p_partkey) AS z FROM part GROUP BY ALL)),
    k AS (SELECT p_type AS region, CASE WHEN p_name LIKE 's%' THEN split_part(p_name, ' ', 1) WHEN p_name LIKE 'c%' THEN upper(p_name) || ' 2' WHEN p_name LIKE 'h%' THEN 'zone ' || length(p_name) ELSE p_name END AS name, avg(p_retailprice) + 1 AS y FROM part GROUP BY ALL),
    o AS (SELECT c.*, n.name AS ranked FROM c LEFT JOIN n USING (region, code)),
    e AS (SELECT o.*, k.name AS known, abs(x - y) AS d FROM o LEFT JOIN k ON k.region = o.region AND upper(k.name) = upper(ranked)),
    h AS (SELECT e.region, ranked, min(k.name) AS held FROM (SELECT DISTINCT region, ranked FROM e WHERE known IS NULL AND ranked IS NOT NULL) e JOIN k ON k.region = e.region AND (contains(upper(replace(ranked, ' ', '')), upper(replace(k.name, ' ', ''))) OR contains(upper(replace(k.name, ' ', '')), upper(replace(ranked, ' ', '')))) GROUP BY ALL),
    p AS (SELECT o.region, o.code, k.name, abs(x - y) AS cost FROM o JOIN k USING (region) WHERE ranked IS NULL),
    m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY region, code ORDER BY cost, name) = 1 AND row_number() OVER (PARTITION BY region, name ORDER BY cost, code) = 1),
    f AS (SELECT e.region, e.code, coalesce(known, held, e.ranked, m.name) AS name, CASE WHEN known IS NOT NULL THEN 'rank_known' WHEN held IS NOT NULL THEN 'rank_contained' WHEN e.ranked IS NOT NULL THEN 'rank' WHEN m.name IS NOT NULL THEN 'feature' ELSE 'unmapped' END AS method, CASE WHEN known IS NOT NULL THEN d WHEN e.ranked IS NULL THEN m.cost END AS cost
          FROM e LEFT JOIN h ON h.region = e.region AND h.ranked = e.ranked LEFT JOIN m ON m.region = e.region AND m.code = e.code)
    SELECT *, CASE WHEN method = 'rank_known' AND cost < 15 OR method = 'feature' AND cost < 12 THEN 'high' WHEN method LIKE 'rank%' OR cost < 25 THEN 'medium' ELSE 'low' END AS confidence FROM f""")
def _(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_type", "region")
    codes = part.groupBy("region", (2 * F.col("p_size")).alias("code")).agg(F.avg("p_retailprice").alias("x"))
    names = part.groupBy("region", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("zone_code"))
    name = F.col("p_name")
    told = F.when(name.like("s%"), F.substring_index(name, " ", 1)).when(name.like("c%"), F.concat(F.upper(name), F.lit(" 2"))).when(name.like("h%"), F.concat(F.lit("zone "), F.length(name).cast("string"))).otherwise(name)
    known = part.groupBy("region", told.alias("name")).agg((F.avg("p_retailprice") + 1).alias("x"))
    ranks = names.groupBy("region").agg(F.count("*").alias("n"))
    beyond = codes.join(ranks, "region").where("code > n or code < 1").drop("n")
    matched = W.mutual_nearest(beyond, known, "region", ["x"])
    return W.code_crosswalk(codes, names, known, "region", ["x"], matched)
