"""What-if reallocation of shares: deltas, rules, covariates, and deterministic ensembles.

Long form: one row for each contest and option with its share in percent. Shares never fall below 0; rescaling leaves a
contest whose shares sum to 0 as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import selection


def ranked_by(rows: DataFrame, share: str = "sim_share", key: str = "contest") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(share), "option")
    return rows.withColumn("sim_rank", F.row_number().over(order).cast("long"))


def apply_deltas(results: DataFrame, deltas: DataFrame, keys: Sequence[str] = ("region", "option")) -> DataFrame:
    """Adds each key's swing to the share, floor 0, and ranks again. deltas: keys, swing."""
    moved = results.join(deltas.select(*keys, "swing"), list(keys), "left")
    share = F.greatest(F.col("vote_share") + F.coalesce("swing", F.lit(0.0)), F.lit(0.0))
    return ranked_by(moved.withColumn("sim_share", share).drop("swing"))


def rescale(rows: DataFrame, share: str = "sim_share", key: str = "contest") -> DataFrame:
    total = F.sum(share).over(Window.partitionBy(key))
    return rows.withColumn(share, F.when(total > 0, 100 * F.col(share) / total).otherwise(F.col(share)))


def apply_deltas_zero_sum(results: DataFrame, deltas: DataFrame, keys: Sequence[str] = ("region", "option")) -> DataFrame:
    return ranked_by(rescale(apply_deltas(results, deltas, keys).drop("sim_rank")))


def validate_deltas(deltas: DataFrame, keys: Sequence[str] = ("region", "option")) -> DataFrame:
    """Bad keys: repeated, or with a swing that is no number. Raises on missing columns."""
    if missing := [c for c in (*keys, "swing") if c not in deltas.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    found = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.col("swing").cast("string").try_cast("double")).alias("numbers"))
    return found.where("n > 1 or numbers < n").withColumn("issue", F.when(F.col("n") > 1, "duplicate").otherwise("not a number"))


def project(results: DataFrame, rules: DataFrame, others: float = 0.0) -> DataFrame:
    """rules: region (null: all), option, delta. A region's rule goes before the general one; options without a rule move by
    `others`. Shares are clamped to 0..100 and rescaled; adds sim_share, sim_rank and the base winner."""
    general = rules.where("region is null").select("option", F.col("delta").alias("d_all"))
    local = rules.where("region is not null").select("region", "option", F.col("delta").alias("d_own"))
    moved = results.join(local, ["region", "option"], "left").join(general, "option", "left")
    share = F.col("vote_share") + F.coalesce("d_own", "d_all", F.lit(others))
    return ranked_by(rescale(moved.withColumn("sim_share", F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))).drop("d_own", "d_all")))


def simulated_base(results: DataFrame, contests: DataFrame, named: Mapping[str, str], region: str | None = None, low_quality: bool = True, low: Sequence[str] = ("election_only", "low"), rest: str = "OTHERS") -> DataFrame:
    """Base shares of the contests that a scenario simulates: region, contest, option, vote_share, rank, completeness.

    contests: contest, region, winner, quality and the columns of `named` (option -> column of its share). With `region` only that
    region is simulated; without `low_quality` contests with a label in `low` are left out. Contests with rows in `results` are full; of
    the others only the named shares are known: they are limited, and what is left of 100 goes to the winner, or to `rest` where
    the winner is a named option (or unknown). Rank 1 is the winner's row.
    """
    kept = contests if region is None else contests.where(F.col("region") == region)
    if not low_quality:
        kept = kept.where(~F.coalesce(F.col("quality").isin(*low), F.lit(False)))
    full = results.join(kept.select("contest"), "contest", "left_semi").select("region", "contest", "option", "vote_share", "rank", F.lit("full").alias("completeness"))
    held = results.select("contest").distinct()
    known = [F.struct(F.lit(o).alias("option"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("vote_share")) for o, c in named.items()]
    left = F.greatest(F.lit(0.0), 100 - sum((x["vote_share"] for x in known), F.lit(0.0)))
    other = F.when(F.col("winner").isin(*named), F.lit(rest)).otherwise(F.coalesce("winner", F.lit(rest)))
    rows = kept.join(held, "contest", "left_anti").select("region", "contest", "winner", F.inline(F.array(*known, F.struct(other.alias("option"), left.alias("vote_share")))))
    first = F.when(F.col("option") == F.coalesce("winner", F.lit(rest)), F.lit(1)).cast("long")
    return full.unionByName(rows.select("region", "contest", "option", "vote_share", first.alias("rank"), F.lit("limited").alias("completeness")))


def projected_winners(projected: DataFrame) -> DataFrame:
    """One row for each contest: base and projected winner, margin, changed, confidence by margin."""
    at = lambda r, c: F.max(F.when(F.col("sim_rank") == r, F.col(c)))
    margin = at(1, "sim_share") - F.coalesce(at(2, "sim_share"), F.lit(0.0))
    out = projected.groupBy("contest", "region").agg(F.max(F.when(F.col("rank") == 1, F.col("option"))).alias("base_winner"), at(1, "option").alias("sim_winner"), margin.alias("sim_margin"))
    level = F.when(F.col("sim_margin") >= 10, "high").when(F.col("sim_margin") >= 3, "medium").otherwise("low")
    return out.withColumn("changed", F.col("base_winner") != F.col("sim_winner")).withColumn("confidence", level)


def scenario_summary(winners: DataFrame, options: Sequence[str]) -> DataFrame:
    seats = [F.count_if(F.col("sim_winner") == o).alias(f"seats_{k}") for k, o in enumerate(options)]
    return winners.agg(*seats, F.count_if("changed").alias("changed"), F.count_if(F.col("confidence") == "low").alias("low"), F.count("*").alias("n"))


def covariate_deltas(results: DataFrame, covariates: DataFrame, effects: DataFrame) -> DataFrame:
    """covariates: contest, variable, value; effects: variable, option, effect. Adds value * effect to the option (which it may
    create), floor 0, rescaled and ranked."""
    moves = covariates.join(effects, "variable").groupBy("contest", "option").agg(F.sum(F.col("value") * F.col("effect")).alias("delta"))
    both = results.select("contest", "option", "vote_share").join(moves, ["contest", "option"], "full_outer")
    share = F.greatest(F.coalesce("vote_share", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0)), F.lit(0.0))
    return ranked_by(rescale(both.select("contest", "option", share.alias("sim_share"))))


def group_shares(results: DataFrame, groups: DataFrame, others: str = "Others", unknown: Sequence[str] = ("Unknown",)) -> DataFrame:
    """Shares of option groups; options without a group go to `others`, groups of `unknown` are dropped."""
    joined = results.join(groups.select("option", "group"), "option", "left").withColumn("group", F.coalesce("group", F.lit(others)))
    return joined.where(~F.col("group").isin(*unknown)).groupBy("contest", "region", "group").agg(F.sum("vote_share").alias("share"))


def scenario_base(ranked: DataFrame) -> DataFrame:
    """Per contest: number of options, sum of shares, complete (at least 90 and two options), quality."""
    out = ranked.groupBy("contest", "region").agg(F.count("*").alias("options"), F.sum("vote_share").alias("total"), F.max(F.when(F.col("rank") == 1, F.col("option"))).alias("winner"))
    complete = (F.col("total") >= 90) & (F.col("options") >= 2)
    return out.withColumn("complete", complete).withColumn("quality", F.when(complete & (F.col("options") >= 3), "high").when(complete, "medium").otherwise("low"))


def md5_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on its parts alone: the first 32 bits of their md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number by Box and Muller on two hashed uniforms; the same under any partitioning."""
    u, v = (md5_uniform(F.lit(f"{seed}:{k}"), *[p.cast("string") for p in parts]) for k in (1, 2))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def ensemble(base: DataFrame, draws: int, seed: int = 1, swing: float = 0.0, period_sd: float = 1.0, region_sd: float = 1.5, contest_sd: float = 2.5, independent: bool = False) -> DataFrame:
    """base: contest, region, group, share. One row for each draw and contest: winner and its share.

    The same noise (period + region + contest) moves every group of a contest, so winners change through the floor at 0 only;
    independent: each group has its own. Shares within 1e-9 tie and go to the first group. Draws are exploded, so no shuffle comes before the aggregate by (draw, contest).
    """
    rows = base.select("contest", "region", "group", "share", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    own = [F.col("group")] if independent else []
    noise = period_sd * normal(seed, F.lit("p"), F.col("draw"), *own) + region_sd * normal(seed, F.lit("r"), F.col("draw"), F.col("region"), *own) + contest_sd * normal(seed, F.lit("c"), F.col("draw"), F.col("contest"), *own)
    moved = rows.select("draw", "contest", "region", "group", F.greatest(F.col("share") + swing + noise, F.lit(0.0)).alias("s"))
    best = moved.groupBy("draw", "contest", "region").agg(F.min(F.struct((-F.round("s", 9)).alias("neg"), "group", "s")).alias("x"), F.sum("s").alias("total"))
    share = F.when(F.col("total") > 0, 100 * F.col("x.s") / F.col("total")).otherwise(F.lit(100 / 3))
    return best.select("draw", "contest", "region", F.col("x.group").alias("winner"), share.alias("winner_share"))


def ensemble_seats(drawn: DataFrame, groups: DataFrame, draws: int) -> DataFrame:
    """One row for each draw (1 to draws) and group, with 0 seats where the group wins none. groups: group, all of the base's and any more."""
    none = groups.select("group").distinct().select(F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "group", F.lit(0).cast("long").alias("seats"))
    won = drawn.groupBy("draw", F.col("winner").alias("group")).agg(F.count("*").alias("seats"))
    return won.unionByName(none).groupBy("draw", "group").agg(F.sum("seats").alias("seats"))


def index_percentile(counts: DataFrame, keys: Sequence[str], value: str, n: str, shares: Sequence[float]) -> DataFrame:
    """counts: keys, value, n (rows of that value). Value at place floor(p * (N - 1)) in order, for each p, as p<percent>."""
    found = selection.percentiles(counts, keys, value, {f"p{round(100 * p)}": p for p in shares}, weight=n, between=False)
    kind = counts.schema[value].dataType
    return found.select(*keys, *[F.col(c).cast(kind).alias(c) for c in found.columns if c not in keys])


def histogram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))


def ensemble_summary(seats: DataFrame, contests: int, hung: bool = False, rest: Sequence[str] = ()) -> DataFrame:
    """Per group: probabilities of most seats and of a majority, and the 10th, 50th and 90th percentile of seats over all draws.

    hung: adds the probability that no group has a majority; one of a group in `rest` (options that form no alliance) does not count.
    """
    held = (F.col("seats") > contests / 2) & ~F.col("group").isin(*rest)
    best = seats.groupBy("draw").agg(F.min(F.struct((-F.col("seats")).alias("neg"), "group"))["group"].alias("first"), F.max(held).alias("held"))
    draws, open_draws = best.agg(F.count("*"), F.count_if(~F.col("held"))).first()
    led = seats.join(best, "draw").groupBy("group").agg((F.count_if(F.col("first") == F.col("group")) / draws).alias("plurality"), (F.count_if(F.col("seats") > contests / 2) / draws).alias("majority"))
    out = led.join(index_percentile(histogram(seats, ["group"], "seats"), ["group"], "seats", "n", (0.1, 0.5, 0.9)), "group")
    return out.withColumn("hung", F.lit(open_draws / max(draws, 1))) if hung else out


def ensemble_contests(drawn: DataFrame, base_winners: DataFrame, volatile: float = 0.15) -> DataFrame:
    """Per contest: modal winner and its probability, probability that the base winner (contest, winner) loses, volatile."""
    counts = drawn.groupBy("contest", "winner").agg(F.count("*").alias("n"))
    base = base_winners.select("contest", F.col("winner").alias("base"))
    out = counts.join(base, "contest").groupBy("contest").agg(F.min(F.struct((-F.col("n")).alias("neg"), "winner")).alias("x"), F.sum("n").alias("all"), F.sum(F.when(F.col("winner") == F.col("base"), F.col("n")).otherwise(0)).alias("kept"))
    flip = 1 - F.col("kept") / F.col("all")
    return out.select("contest", F.col("x.winner").alias("modal_winner"), (-F.col("x.neg") / F.col("all")).alias("probability"), flip.alias("flip_probability"), (flip >= volatile).alias("volatile"))
