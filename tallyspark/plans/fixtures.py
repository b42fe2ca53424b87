"""Domain tables derived from the star-schema tables, for Spark and, under the same names, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import contest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """period, region, contest, option, votes: quantities sold, by half of the time span, nation, size and brand."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    period = F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"), 1).otherwise(2)
    sums = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sums = sums.groupBy(period.alias("period"), "s_nationkey", "p_size", F.col("p_brand").alias("option")).agg(F.sum("l_quantity").alias("votes"))
    named = sums.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("period", F.col("n_name").alias("region"), F.concat_ws("__", "n_name", "p_size").alias("contest"), "option", "votes")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contest.build_results(results(spark, sf_dir))


def periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ranked(spark, sf_dir)
    return rows.where("period = 1").drop("period"), rows.where("period = 2").drop("period")


def option_group(option) -> F.Column:
    """A brand's group: G0, G1 or G2 by its number."""
    return F.concat(F.lit("G"), (F.regexp_extract(option, r"(\d+)$", 1).cast("int") % 3).cast("string"))


def option_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("option")).distinct()
    return brands.withColumn("group", option_group(F.col("option")))


CTE = {
    "results": """results AS (
        SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 1 ELSE 2 END AS period, n_name AS region,
               n_name || '__' || p_size AS contest, p_brand AS option, sum(l_quantity) AS votes
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY ALL)""",
    "ranked": """ranked AS (
        SELECT *, row_number() OVER w AS rank, 100 * votes / nullif(sum(votes) OVER (PARTITION BY period, contest), 0) AS vote_share,
               row_number() OVER w = 1 AS winner,
               CASE WHEN row_number() OVER w = 1 THEN votes - lead(votes) OVER w END AS margin_votes
        FROM results WINDOW w AS (PARTITION BY period, contest ORDER BY votes DESC, option))""",
    "features": """features AS (
        SELECT period, contest, min(region) AS region, max(option) FILTER (rank = 1) AS winner, max(vote_share) FILTER (rank = 1) AS winner_share,
               max(margin_votes) AS margin_votes, max(vote_share) FILTER (rank = 1) - max(vote_share) FILTER (rank = 2) AS top2_margin_pct,
               1 / nullif(sum(power(vote_share / 100, 2)), 0) AS effective_options
        FROM ranked GROUP BY period, contest)""",
    "compared": """compared AS (
        SELECT p.contest, c.region, p.winner AS prev_winner, c.winner AS curr_winner, p.winner_share AS prev_share, c.winner_share AS curr_share,
               p.winner <> c.winner AS flipped
        FROM (SELECT * FROM features WHERE period = 1) p JOIN (SELECT * FROM features WHERE period = 2) c USING (contest))""",
    "swings": """swings AS (
        SELECT coalesce(p.contest, c.contest) AS contest, coalesce(p.option, c.option) AS option, coalesce(c.region, p.region) AS region,
               coalesce(p.vote_share, 0) AS prev_share, coalesce(c.vote_share, 0) AS curr_share,
               coalesce(c.vote_share, 0) - coalesce(p.vote_share, 0) AS swing
        FROM (SELECT * FROM ranked WHERE period = 1) p FULL JOIN (SELECT * FROM ranked WHERE period = 2) c ON p.contest = c.contest AND p.option = c.option)""",
    "swing_features": """swing_features AS (
        SELECT contest, max(swing) AS max_swing, min(swing) AS min_swing, avg(abs(swing)) AS mean_abs_swing, max(swing) - min(swing) AS swing_range
        FROM swings GROUP BY contest)""",
    "volatility": """volatility AS (
        SELECT c.contest, c.region, c.flipped, c.prev_winner, c.curr_winner, f.top2_margin_pct, f.effective_options, s.mean_abs_swing,
               40 * CAST(c.flipped AS INT) + (20 - least(f.top2_margin_pct, 20)) + 5 * f.effective_options + 2 * s.mean_abs_swing + CASE WHEN f.top2_margin_pct IS NULL THEN NULL ELSE 0 END AS score
        FROM compared c LEFT JOIN (SELECT * FROM features WHERE period = 2) f USING (contest) LEFT JOIN swing_features s USING (contest))""",
    "option_dim": """option_dim AS (SELECT DISTINCT p_brand AS option, 'G' || (CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 3) AS "group" FROM part)""",
    "grouped": """grouped AS (
        SELECT r.period, r.region, r.contest, d."group", sum(r.vote_share) AS share FROM ranked r JOIN option_dim d USING (option) GROUP BY ALL)""",
}
NEEDS = {"ranked": ["results"], "features": ["ranked"], "compared": ["features"], "swings": ["ranked"], "swing_features": ["swings"], "volatility": ["compared", "features", "swing_features"], "grouped": ["ranked", "option_dim"]}


def sql(names: str, body: str) -> str:
    """`body` under the named common table expressions and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return (f"WITH {', '.join(CTE[n] for n in order)} " if order else "") + body
