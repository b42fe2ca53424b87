"""Registered queries: windows, contest aggregates, comparison of periods, composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import contest as C
from tallyspark.plans import fixtures as X
from tallyspark.plans.registry import query
from tallyspark.plans.fixtures import sql
from tallyspark.sources.shared import stored

KEY = ["Brand#1", "Brand#2"]


def pairs(spark, d, options=()):
    """Both periods of each contest from one pass over the results."""
    return C.contest_pairs(X.results(spark, d), options=options)


def features(spark, d, side):
    return C.features_of(pairs(spark, d), side)


def both(spark, d):
    """(features before, features after), written once for what reads them several times"""
    found = stored(pairs(spark, d), "pairs")
    return C.features_of(found, "prev"), C.features_of(found, "curr")


def scores(spark, d):
    return C.volatility_of(pairs(spark, d))


@query("w1_rank_options", sql("ranked", "SELECT period, contest, option, votes, rank, winner FROM ranked"))
def _(spark, d):
    return C.rank_options(X.results(spark, d)).drop("region")


@query("w2_vote_share", sql("ranked", "SELECT period, contest, option, vote_share FROM ranked"))
def _(spark, d):
    return C.vote_share(X.results(spark, d)).select("period", "contest", "option", "vote_share")


@query("w3_margin_votes", sql("ranked", "SELECT period, contest, option, margin_votes FROM ranked WHERE winner"))
def _(spark, d):
    return C.margin_votes(C.rank_options(X.results(spark, d))).where("winner").select("period", "contest", "option", "margin_votes")


@query("w4_top_k", sql("ranked", "SELECT period, contest, option, rank FROM ranked WHERE rank <= 3"))
def _(spark, d):
    return C.top_k(C.rank_options(X.results(spark, d)), 3).select("period", "contest", "option", "rank")


@query("w5_top2_margin_pct", sql("features", "SELECT period, contest, top2_margin_pct FROM features"))
def _(spark, d):
    return C.top2_margin_pct(X.ranked(spark, d))


@query("w6_runner_up", sql("ranked", "SELECT period, contest, max(option) FILTER (rank = 2) AS runner_up FROM ranked GROUP BY 1, 2"))
def _(spark, d):
    return C.runner_up(C.rank_options(X.results(spark, d)))


@query("c1_build_results", sql("ranked", "SELECT * FROM ranked"))
def _(spark, d):
    return X.ranked(spark, d)


@query("c2_contest_features", sql("features option_dim", 'SELECT f.*, "group" FROM features f LEFT JOIN option_dim ON winner = option'))
def _(spark, d):
    return C.contest_features(X.ranked(spark, d), dim=X.option_dim(spark, d))


@query("a1_seat_counts", sql("features", "SELECT period, region, winner, count(*) AS seats FROM features GROUP BY ALL"))
def _(spark, d):
    return C.seat_counts(C.contest_features(X.ranked(spark, d)), ["period", "region", "winner"])


@query("a2_effective_number", sql("features", "SELECT period, contest, effective_options FROM features"))
def _(spark, d):
    return X.ranked(spark, d).groupBy("period", "contest").agg(C.effective_number(F.col("vote_share")).alias("effective_options"))


@query("a3_vote_seat_distortion", sql("ranked", """SELECT option, vote_pct, seat_pct, seat_pct - vote_pct AS gap FROM (
    SELECT option, 100 * sum(votes) / sum(sum(votes)) OVER () AS vote_pct, 100 * count(*) FILTER (winner) / sum(count(*) FILTER (winner)) OVER () AS seat_pct
    FROM ranked WHERE period = 1 GROUP BY option)"""))
def _(spark, d):
    return C.vote_seat_distortion(X.periods(spark, d)[0])


@query("a4_flip_matrix", sql("compared", "SELECT prev_winner, curr_winner, count(*) AS n FROM compared WHERE flipped GROUP BY ALL"))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.flip_matrix(C.compare_winners(fp, fc))


@query("a5_region_swing_mean", sql("swings", "SELECT region, option, avg(swing) AS mean_swing FROM swings GROUP BY ALL"))
def _(spark, d):
    return C.region_swing_mean(C.option_swings(*X.periods(spark, d)))


@query("a6_swing_features", sql("swing_features", "SELECT * FROM swing_features"))
def _(spark, d):
    return C.swing_features(C.option_swings(*X.periods(spark, d)))


@query("a7_region_outcomes", sql("volatility features option_dim", """, r AS (
    SELECT f.*, v.flipped, v.score, o."group" FROM features f LEFT JOIN volatility v USING (contest) LEFT JOIN option_dim o ON f.winner = o.option WHERE period = 2)
    SELECT region, count(*) AS seats, count(*) FILTER (flipped) AS flips, 100.0 * count(*) FILTER (flipped) / count(flipped) AS flip_rate, avg(winner_share) AS mean_share,
           avg(top2_margin_pct) AS mean_margin, quantile_cont(top2_margin_pct, 0.5) AS median_margin, count(*) FILTER (top2_margin_pct <= 5) AS close, max(score) AS max_score,
           (SELECT winner FROM r q WHERE q.region = r.region GROUP BY winner ORDER BY count(*) DESC, winner LIMIT 1) AS top_winner,
           (SELECT "group" FROM r q WHERE q.region = r.region AND "group" IS NOT NULL GROUP BY "group" ORDER BY count(*) DESC, "group" LIMIT 1) AS top_group
    FROM r GROUP BY region"""))
def _(spark, d):
    found = stored(pairs(spark, d), "pairs")
    return C.region_outcomes(C.features_of(found, "curr"), C.volatility_of(found), X.option_dim(spark, d))


@query("a8_region_option_summary", sql("swings features", """SELECT s.*, coalesce(p.n, 0) AS prev_seats, coalesce(c.n, 0) AS curr_seats, coalesce(c.n, 0) - coalesce(p.n, 0) AS seat_change
    FROM (SELECT region, option, avg(prev_share) AS mean_prev, avg(curr_share) AS mean_curr, avg(swing) AS mean_swing, max(swing) AS max_swing, min(swing) AS min_swing, count(DISTINCT contest) AS contests FROM swings GROUP BY ALL) s
    LEFT JOIN (SELECT region, winner AS option, count(*) AS n FROM features WHERE period = 1 GROUP BY ALL) p USING (region, option)
    LEFT JOIN (SELECT region, winner AS option, count(*) AS n FROM features WHERE period = 2 GROUP BY ALL) c USING (region, option)"""))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.region_option_summary(C.option_swings(*X.periods(spark, d)), fp, fc)


@query("a9_swing_sensitivity", sql("features", """SELECT s.region, count(*) AS seats, count(*) FILTER (s.winner <> a.winner) AS flips, count(*) FILTER (s.top2_margin_pct <= 5) AS close,
    avg(s.top2_margin_pct) AS mean_margin, quantile_cont(s.top2_margin_pct, 0.5) AS median_margin, count(*) FILTER (s.winner <> a.winner) / count(*) AS flip_rate
    FROM (SELECT * FROM features WHERE period = 2) s JOIN (SELECT * FROM features WHERE period = 1) a USING (contest) GROUP BY s.region"""))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.swing_sensitivity(fp, fc)


@query("a10_region_summary", sql("compared swings", """SELECT c.region, count(*) AS seats, count(*) FILTER (flipped) AS flips, count(*) FILTER (prev_winner = 'Brand#1') AS prev_0, count(*) FILTER (curr_winner = 'Brand#1') AS curr_0,
    count(*) FILTER (prev_winner = 'Brand#2') AS prev_1, count(*) FILTER (curr_winner = 'Brand#2') AS curr_1, any_value(swing_0) AS swing_0, any_value(swing_1) AS swing_1, any_value(g.option) AS top_gainer
    FROM compared c LEFT JOIN (SELECT region, avg(swing) FILTER (option = 'Brand#1') AS swing_0, avg(swing) FILTER (option = 'Brand#2') AS swing_1 FROM swings GROUP BY region) m USING (region)
    LEFT JOIN (SELECT region, option FROM (SELECT region, option, avg(swing) AS s FROM swings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY region ORDER BY s DESC, option) = 1) g USING (region)
    GROUP BY c.region"""))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.region_summary(C.compare_winners(fp, fc), C.option_swings(*X.periods(spark, d)), KEY)


@query("a29_contests_per_region", sql("results", "SELECT region, count(DISTINCT contest) AS contests FROM results GROUP BY region"))
def _(spark, d):
    return X.results(spark, d).groupBy("region").agg(F.count_distinct("contest").alias("contests"))


@query("j4_compare_winners", sql("compared", "SELECT * FROM compared"))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.compare_winners(fp, fc)


@query("j5_option_swings", sql("swings", "SELECT * FROM swings"))
def _(spark, d):
    return C.option_swings(*X.periods(spark, d))


@query("j6_unmatched", sql("ranked", """SELECT DISTINCT contest, region, 'previous' AS period, 'missing in current' AS reason FROM ranked WHERE period = 1 AND contest NOT IN (SELECT contest FROM ranked WHERE period = 2)
    UNION ALL SELECT DISTINCT contest, region, 'current', 'missing in previous' FROM ranked WHERE period = 2 AND contest NOT IN (SELECT contest FROM ranked WHERE period = 1)"""))
def _(spark, d):
    return C.unmatched(*X.periods(spark, d))


@query("c3_volatility", sql("volatility", "SELECT * FROM volatility"))
def _(spark, d):
    return scores(spark, d).orderBy(F.desc_nulls_last("score"), "contest")


@query("c4_flip_report", sql("features", """SELECT a.contest, a.region, a.winner AS actual_winner, a.top2_margin_pct, s.winner AS sim_winner, s.winner_share AS sim_share, a.winner <> s.winner AS flipped
    FROM (SELECT * FROM features WHERE period = 1) a JOIN (SELECT * FROM features WHERE period = 2) s USING (contest)"""))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.flip_report(fp, fc)


@query("c5_battlegrounds", sql("features volatility", """SELECT a.contest, a.region, a.winner AS actual_winner, a.top2_margin_pct, s.winner AS sim_winner, s.winner_share AS sim_share, a.winner <> s.winner AS flipped, v.score, v.mean_abs_swing
    FROM (SELECT * FROM features WHERE period = 1) a JOIN (SELECT * FROM features WHERE period = 2) s USING (contest) LEFT JOIN volatility v USING (contest)"""))
def _(spark, d):
    fp, fc = both(spark, d)
    return C.battlegrounds(C.flip_report(fp, fc), scores(spark, d))


PIVOT = ", ".join(f"max({m}) FILTER (option = '{o}') AS \"{o}_{m}\"" for o in KEY for m in ("prev_share", "curr_share", "swing"))


@query("r5_pivot_option", sql("swings", f"SELECT contest, {PIVOT} FROM swings GROUP BY contest"))
def _(spark, d):
    return C.pivot_option(C.option_swings(*X.periods(spark, d)), KEY)


@query("c6_master", sql("compared features swings", f"""SELECT c.*, p.top2_margin_pct AS prev_margin, p.effective_options AS prev_effective, f.top2_margin_pct AS curr_margin, f.effective_options AS curr_effective,
    f.top2_margin_pct - p.top2_margin_pct AS margin_change, v.* EXCLUDE (contest) FROM compared c
    LEFT JOIN (SELECT * FROM features WHERE period = 1) p USING (contest) LEFT JOIN (SELECT * FROM features WHERE period = 2) f USING (contest)
    LEFT JOIN (SELECT contest, {PIVOT} FROM swings GROUP BY contest) v USING (contest)"""))
def _(spark, d):
    return C.master_of(pairs(spark, d, KEY), KEY)
