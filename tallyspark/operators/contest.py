"""Contests: options compete for votes in a contest of a region, in one period or in two that are compared.

Ties are always broken by the option (ascending). Rows with a null contest or option are left out where a key is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import selection

KEYS = ("period", "contest")


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.col("votes").desc_nulls_last(), "option")


def rank_options(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds rank (1, 2, ... by votes) and winner (rank 1)."""
    return rows.withColumn("rank", F.row_number().over(_order(keys)).cast("long")).withColumn("winner", F.col("rank") == 1)


def vote_share(rows: DataFrame, keys: Sequence[str] = KEYS, measure: str = "votes", out: str = "vote_share") -> DataFrame:
    """Adds the measure's share of its group in percent; null in a group of sum 0."""
    total = F.sum(measure).over(Window.partitionBy(*keys))
    return rows.withColumn(out, 100 * F.col(measure) / F.when(total != 0, total))


def margin_votes(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the winner's lead in votes over the next option; null for others and where no other runs."""
    order = _order(keys)
    return rows.withColumn("margin_votes", F.when(F.row_number().over(order) == 1, F.col("votes") - F.lead("votes").over(order)))


def build_results(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """rank, winner, vote_share and margin_votes over one partitioning by contest."""
    keyed = rows.where(" and ".join(f"{k} is not null" for k in (*keys, "option")))
    return margin_votes(vote_share(rank_options(keyed, keys), keys), keys)


def top_k(ranked: DataFrame, k: int = 2) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def top2_margin_pct(ranked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, top2_margin_pct: gap of the first two shares, null for a single option."""
    share = lambda r: F.max(F.when(F.col("rank") == r, F.col("vote_share")))
    return ranked.groupBy(*keys).agg((share(1) - share(2)).alias("top2_margin_pct"))


def runner_up(ranked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 2, F.col("option"))).alias("runner_up"))


def effective_number(share: Column) -> Column:
    """Aggregate: 1 / sum of squared shares; null if that sum is 0."""
    total = F.sum(F.pow(share / 100, 2))
    return 1 / F.when(total != 0, total)


def contest_features(ranked: DataFrame, keys: Sequence[str] = KEYS, dim: DataFrame | None = None) -> DataFrame:
    """One row for each contest: winner, its share, margins, effective number of options, and the winner's dimension row."""
    first, second = F.col("rank") == 1, F.col("rank") == 2
    share = lambda r: F.max(F.when(r, F.col("vote_share")))
    out = ranked.groupBy(*keys).agg(
        F.min("region").alias("region"), F.max(F.when(first, F.col("option"))).alias("winner"), share(first).alias("winner_share"), F.max("margin_votes").alias("margin_votes"),
        (share(first) - share(second)).alias("top2_margin_pct"), effective_number(F.col("vote_share")).alias("effective_options"),
    )
    return out if dim is None else out.join(dim.withColumnRenamed("option", "winner"), "winner", "left")


def seat_counts(winners: DataFrame, by: Sequence[str]) -> DataFrame:
    return winners.groupBy(*by).agg(F.count("*").alias("seats"))


def vote_seat_distortion(ranked: DataFrame) -> DataFrame:
    """For each option: share of all votes, share of all seats (0 without one), gap."""
    sums = ranked.groupBy("option").agg(F.sum("votes").alias("votes"), F.count_if("winner").alias("seats"))
    totals = sums.agg(F.sum("votes").alias("v"), F.sum("seats").alias("s"))
    vote, seat = 100 * F.col("votes") / totals.select("v").scalar(), 100 * F.col("seats") / totals.select("s").scalar()
    return sums.select("option", vote.alias("vote_pct"), seat.alias("seat_pct"), (seat - vote).alias("gap"))


def compare_winners(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Contest features of two periods: contests of both, their winners and whether the winner changed."""
    p = prev.select("contest", F.col("winner").alias("prev_winner"), F.col("winner_share").alias("prev_share"))
    c = curr.select("contest", "region", F.col("winner").alias("curr_winner"), F.col("winner_share").alias("curr_share"))
    return p.join(c, "contest").withColumn("flipped", F.col("prev_winner") != F.col("curr_winner"))


def option_swings(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Shares of every option in either period; a missing share counts 0."""
    p = prev.select("contest", "option", F.col("region").alias("r1"), F.col("vote_share").alias("prev_share"))
    c = curr.select("contest", "option", F.col("region").alias("r2"), F.col("vote_share").alias("curr_share"))
    both = p.join(c, ["contest", "option"], "full_outer").select("contest", "option", F.coalesce("r2", "r1").alias("region"), F.coalesce("prev_share", F.lit(0.0)).alias("prev_share"), F.coalesce("curr_share", F.lit(0.0)).alias("curr_share"))
    return both.withColumn("swing", F.col("curr_share") - F.col("prev_share"))


def option_pairs(rows: DataFrame, first: object = 1, second: object = 2) -> DataFrame:
    """rows: period, region, contest, option, votes, one row for each option of a contest in a period. One row for each contest and
    option of either period: in_prev, in_curr, and of both the region, votes, rank, share (null where it does not run) and the swing.

    One grouped pass and windows over one partitioning by contest take the place of ranking both periods and joining them.
    """
    own = rows.where("period is not null and contest is not null and option is not null").where(F.col("period").isin(first, second))
    at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    sides = (("prev", first), ("curr", second))
    cells = [x for side, p in sides for x in (F.bool_or(F.col("period") == p).alias(f"in_{side}"), at(p, "region").alias(f"{side}_region"), at(p, "votes").alias(f"{side}_votes"))]
    wide = own.groupBy("contest", "option").agg(*cells)
    of_contest = Window.partitionBy("contest")
    for side, _ in sides:
        votes, runs = F.col(f"{side}_votes"), F.col(f"in_{side}")
        place = F.row_number().over(of_contest.orderBy(F.desc(f"in_{side}"), votes.desc_nulls_last(), "option"))
        total = F.nullif(F.sum(votes).over(of_contest), F.lit(0))
        wide = wide.withColumns({f"{side}_rank": F.when(runs, place.cast("long")), f"{side}_share": 100 * votes / total})
    return wide.withColumn("swing", F.coalesce("curr_share", F.lit(0.0)) - F.coalesce("prev_share", F.lit(0.0)))


def contest_pairs(rows: DataFrame, first: object = 1, second: object = 2, options: Sequence[str] = ()) -> DataFrame:
    """`rows` as of `option_pairs`. One row for each contest of either period: of both the number of options (0: not held), region,
    winner, winner_share, margin_votes, top2_margin_pct and effective_options as <side>_<name>, whether the winner changed (null
    unless both were held), the range and mean of the swings; and of each named option prev_share, curr_share and swing as <option>_<name>.
    """
    aggs = []
    for side in ("prev", "curr"):
        top = lambda r, c: F.max(F.when(F.col(f"{side}_rank") == r, F.col(c)))  # noqa: B023, E731
        share, votes = f"{side}_share", f"{side}_votes"
        found = {
            "options": F.count_if(f"in_{side}"), "region": F.min(f"{side}_region"), "winner": top(1, "option"), "winner_share": top(1, share),
            "margin_votes": top(1, votes) - top(2, votes), "top2_margin_pct": top(1, share) - top(2, share), "effective_options": effective_number(F.col(share)),
        }
        aggs += [c.alias(f"{side}_{n}") for n, c in found.items()]
    aggs += [F.max("swing").alias("max_swing"), F.min("swing").alias("min_swing"), F.avg(F.abs("swing")).alias("mean_abs_swing"), (F.max("swing") - F.min("swing")).alias("swing_range")]
    for o in options:
        held = {"prev_share": F.coalesce("prev_share", F.lit(0.0)), "curr_share": F.coalesce("curr_share", F.lit(0.0)), "swing": F.col("swing")}
        aggs += [F.max(F.when(F.col("option") == o, c)).alias(f"{o}_{n}") for n, c in held.items()]
    both = F.when((F.col("prev_options") > 0) & (F.col("curr_options") > 0), F.col("prev_winner") != F.col("curr_winner"))
    return option_pairs(rows, first, second).groupBy("contest").agg(*aggs).withColumn("flipped", both)


def features_of(pairs: DataFrame, side: str) -> DataFrame:
    """Contest features of one side (`prev`, `curr`) of `contest_pairs`, as of `contest_features`."""
    names = ("region", "winner", "winner_share", "margin_votes", "top2_margin_pct", "effective_options")
    return pairs.where(F.col(f"{side}_options") > 0).select("contest", *[F.col(f"{side}_{n}").alias(n) for n in names])


def volatility_of(pairs: DataFrame) -> DataFrame:
    """`volatility` of the contests that both sides of `contest_pairs` held."""
    kept = pairs.where("prev_options > 0 and curr_options > 0").withColumn("_margin", F.col("curr_top2_margin_pct"))
    out = kept.select("contest", F.col("curr_region").alias("region"), "flipped", "prev_winner", "curr_winner", F.col("_margin").alias("top2_margin_pct"), F.col("curr_effective_options").alias("effective_options"), "mean_abs_swing")
    return out.withColumn("score", volatility_score())


def volatility_score() -> Column:
    margin = F.when(F.col("top2_margin_pct") > 20, F.lit(20.0)).otherwise(F.col("top2_margin_pct"))
    return 40 * F.col("flipped").cast("int") + (20 - margin) + 5 * F.col("effective_options") + 2 * F.col("mean_abs_swing")


def master_of(pairs: DataFrame, options: Sequence[str], turnouts: tuple[DataFrame, DataFrame] | None = None, panel: DataFrame | None = None) -> DataFrame:
    """`master` from `contest_pairs`, which hold the named options."""
    shares = [f"{o}_{m}" for o in options for m in ("prev_share", "curr_share", "swing")]
    named = {"prev_winner_share": "prev_share", "curr_winner_share": "curr_share", "prev_top2_margin_pct": "prev_margin", "prev_effective_options": "prev_effective", "curr_top2_margin_pct": "curr_margin", "curr_effective_options": "curr_effective"}
    out = pairs.where("prev_options > 0 and curr_options > 0").select("contest", F.col("curr_region").alias("region"), "prev_winner", "curr_winner", "flipped", *[F.col(f"`{a}`").alias(b) for a, b in named.items()], *[F.col(f"`{c}`") for c in shares])
    return with_turnout(out.withColumn("margin_change", F.col("curr_margin") - F.col("prev_margin")), turnouts, panel)


def unmatched(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Contests of one period only, with the period and a reason."""
    gone = prev.select("contest", "region").distinct().join(curr, "contest", "left_anti").select("*", F.lit("previous").alias("period"), F.lit("missing in current").alias("reason"))
    new = curr.select("contest", "region").distinct().join(prev, "contest", "left_anti").select("*", F.lit("current").alias("period"), F.lit("missing in previous").alias("reason"))
    return gone.unionByName(new)


def swing_features(swings: DataFrame) -> DataFrame:
    return swings.groupBy("contest").agg(F.max("swing").alias("max_swing"), F.min("swing").alias("min_swing"), F.avg(F.abs("swing")).alias("mean_abs_swing"), (F.max("swing") - F.min("swing")).alias("swing_range"))


def flip_matrix(compared: DataFrame) -> DataFrame:
    return compared.where("flipped").groupBy("prev_winner", "curr_winner").agg(F.count("*").alias("n"))


def region_swing_mean(swings: DataFrame) -> DataFrame:
    return swings.groupBy("region", "option").agg(F.avg("swing").alias("mean_swing"))


def volatility(compared: DataFrame, features: DataFrame, swings: DataFrame) -> DataFrame:
    """40 if flipped, 20 less the margin (at most 20), 5 for each effective option, twice the mean absolute swing; null if a part is."""
    f = features.select("contest", "top2_margin_pct", "effective_options")
    s = swing_features(swings).select("contest", "mean_abs_swing")
    rows = compared.select("contest", "region", "flipped", "prev_winner", "curr_winner").join(f, "contest", "left").join(s, "contest", "left")
    return rows.withColumn("score", volatility_score())


def mode(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """The value of greatest count for each key; ties by value."""
    best = F.min(F.struct((-F.col(n)).alias("neg"), F.col(value)))
    return counts.groupBy(*keys).agg(best[value].alias(value))


def with_median(out: DataFrame, rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """`out` (one row for each key) with the median of `value` over the rows of its key; null without values."""
    found = selection.percentiles(rows.select(key, value), [key], value, {name: 0.5}).withColumnRenamed(key, "_key")
    return out.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def region_outcomes(winners: DataFrame, scores: DataFrame, groups: DataFrame, close: float = 5.0, prev: DataFrame | None = None, key_options: Sequence[str] = ()) -> DataFrame:
    """For each region: seats, flips, most frequent winner and group, mean and median margin, close contests, top score; with the
    features of the period before, also the key options' seats in both (prev_<k>, curr_<k>) and their change (change_<k>)."""
    rows = winners.join(scores.select("contest", "flipped", "score"), "contest", "left").join(groups.withColumnRenamed("option", "winner"), "winner", "left")
    out = rows.groupBy("region").agg(
        F.count("*").alias("seats"), F.count_if("flipped").alias("flips"), (100 * F.count_if("flipped") / F.count("flipped")).alias("flip_rate"), F.avg("winner_share").alias("mean_share"),
        F.avg("top2_margin_pct").alias("mean_margin"), F.count_if(F.col("top2_margin_pct") <= close).alias("close"), F.max("score").alias("max_score"),
    )
    out = with_median(out, rows, "region", "top2_margin_pct", "median_margin")
    top = mode(rows.groupBy("region", "winner").agg(F.count("*").alias("n")), ["region"], "winner").withColumnRenamed("winner", "top_winner")
    group = mode(rows.where("group is not null").groupBy("region", "group").agg(F.count("*").alias("n")), ["region"], "group").withColumnRenamed("group", "top_group")
    out = out.join(top, "region", "left").join(group, "region", "left")
    if prev is None:
        return out
    both = prev.select("region", F.col("winner").alias("p"), F.lit(None).cast("string").alias("c")).unionByName(winners.select("region", F.lit(None).cast("string").alias("p"), F.col("winner").alias("c")))
    seats = both.groupBy("region").agg(*[F.count_if(F.col(side) == o).alias(f"{name}_{k}") for k, o in enumerate(key_options) for side, name in (("p", "prev"), ("c", "curr"))])
    seats = seats.withColumns({f"change_{k}": F.col(f"curr_{k}") - F.col(f"prev_{k}") for k in range(len(key_options))})
    return out.join(seats, "region", "left")


def region_option_summary(swings: DataFrame, prev: DataFrame, curr: DataFrame) -> DataFrame:
    """For each region and option: mean shares, swing range, contests, seats of both periods and their change."""
    out = swings.groupBy("region", "option").agg(F.avg("prev_share").alias("mean_prev"), F.avg("curr_share").alias("mean_curr"), F.avg("swing").alias("mean_swing"), F.max("swing").alias("max_swing"), F.min("swing").alias("min_swing"), F.count_distinct("contest").alias("contests"))
    for name, side in (("prev_seats", prev), ("curr_seats", curr)):
        seats = side.groupBy("region", F.col("winner").alias("option")).agg(F.count("*").alias(name))
        out = out.join(seats, ["region", "option"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.withColumn("seat_change", F.col("curr_seats") - F.col("prev_seats"))


def swing_sensitivity(actual: DataFrame, simulated: DataFrame, close: float = 5.0) -> DataFrame:
    """Contest features before and after a scenario: for each region seats, flips, close contests, margins, flip rate."""
    rows = simulated.join(actual.select("contest", F.col("winner").alias("before")), "contest")
    flips = F.count_if(F.col("winner") != F.col("before"))
    out = rows.groupBy("region").agg(F.count("*").alias("seats"), flips.alias("flips"), F.count_if(F.col("top2_margin_pct") <= close).alias("close"), F.avg("top2_margin_pct").alias("mean_margin"), (flips / F.count("*")).alias("flip_rate"))
    return with_median(out, rows, "region", "top2_margin_pct", "median_margin")


def region_summary(compared: DataFrame, swings: DataFrame, key_options: Sequence[str]) -> DataFrame:
    """For each region: seats of key options in both periods, flips, their mean swings, top gainer, share of contests with both periods."""
    aggs = [F.count("*").alias("seats"), F.count_if("flipped").alias("flips")]
    for k, option in enumerate(key_options):
        aggs += [F.count_if(F.col("prev_winner") == option).alias(f"prev_{k}"), F.count_if(F.col("curr_winner") == option).alias(f"curr_{k}")]
    seats = compared.groupBy("region").agg(*aggs)
    means = swings.groupBy("region").agg(*[F.avg(F.when(F.col("option") == option, F.col("swing"))).alias(f"swing_{k}") for k, option in enumerate(key_options)])
    gain = region_swing_mean(swings).groupBy("region").agg(F.min(F.struct((-F.col("mean_swing")).alias("s"), "option"))["option"].alias("top_gainer"))
    return seats.join(means, "region", "left").join(gain, "region", "left")


def region_quality(rows: DataFrame) -> DataFrame:
    """rows: contest, region, turnout_prev, turnout_curr, coverage, quality. For each region: contests, those with coverage and their
    share, mean change of turnout (where both are known), mean coverage and a label by rule."""
    n, some = F.count("*"), F.count("coverage")
    out = rows.groupBy("region").agg(
        n.alias("contests"), some.alias("covered"), (100 * some / n).alias("coverage_pct"), F.avg(F.col("turnout_curr") - F.col("turnout_prev")).alias("turnout_change"),
        F.avg("coverage").alias("mean_coverage"), F.count_if(F.col("quality") == "high").alias("_high"),
    )
    mean = F.col("mean_coverage")
    label = F.when(F.col("_high") >= 0.5 * F.col("contests"), "high").when(F.col("covered") == 0, "election_only").when(mean >= 0.75, "high").when(mean >= 0.5, "medium").otherwise("low")
    return out.withColumn("label", label).drop("_high")


def flip_report(actual: DataFrame, simulated: DataFrame) -> DataFrame:
    """Winners before and after, flipped contests first, then by margin."""
    a = actual.select("contest", "region", F.col("winner").alias("actual_winner"), "top2_margin_pct")
    s = simulated.select("contest", F.col("winner").alias("sim_winner"), F.col("winner_share").alias("sim_share"))
    return a.join(s, "contest").withColumn("flipped", F.col("actual_winner") != F.col("sim_winner")).orderBy(F.desc("flipped"), F.asc_nulls_last("top2_margin_pct"), "contest")


def battlegrounds(report: DataFrame, scores: DataFrame) -> DataFrame:
    s = scores.select("contest", "score", "mean_abs_swing").dropDuplicates(["contest"])
    return report.join(s, "contest", "left").orderBy(F.desc("flipped"), F.desc_nulls_last("score"), "contest")


def pivot_option(swings: DataFrame, options: Sequence[str], index: str = "contest") -> DataFrame:
    """One row for each contest: previous share, current share and swing of each named option (columns <option>_<measure>)."""
    wide = swings.groupBy(index).pivot("option", list(options)).agg(F.max("prev_share").alias("prev_share"), F.max("curr_share").alias("curr_share"), F.max("swing").alias("swing"))
    return wide


def winner_turnout(rows: DataFrame, turnout: str) -> DataFrame:
    """contest, turnout: the number on the winner's row of each contest."""
    return rows.where("winner").groupBy("contest").agg(F.max(F.col(turnout).cast("double")).alias("turnout"))


def master(compared: DataFrame, prev: DataFrame, curr: DataFrame, swings: DataFrame, options: Sequence[str], turnouts: tuple[DataFrame, DataFrame] | None = None, panel: DataFrame | None = None) -> DataFrame:
    """Spine of both periods' contests: winners, margins and their change, key options' shares.

    turnouts: (contest, turnout) of both periods, adds them and their change; panel: features of the contests, one row for each.
    """
    p = prev.select("contest", F.col("top2_margin_pct").alias("prev_margin"), F.col("effective_options").alias("prev_effective"))
    c = curr.select("contest", F.col("top2_margin_pct").alias("curr_margin"), F.col("effective_options").alias("curr_effective"))
    out = compared.join(p, "contest", "left").join(c, "contest", "left").join(pivot_option(swings, options), "contest", "left")
    return with_turnout(out.withColumn("margin_change", F.col("curr_margin") - F.col("prev_margin")), turnouts, panel)


def with_turnout(out: DataFrame, turnouts: tuple[DataFrame, DataFrame] | None, panel: DataFrame | None) -> DataFrame:
    if turnouts is not None:
        for n, t in zip(("prev", "curr"), turnouts):
            out = out.join(t.select("contest", F.col("turnout").alias(f"{n}_turnout")), "contest", "left")
        out = out.withColumn("turnout_change", F.col("curr_turnout") - F.col("prev_turnout"))
    return out if panel is None else out.join(panel, "contest", "left")
