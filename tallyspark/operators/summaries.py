"""Weighted survey aggregates, coverage, correlations, value priorities and overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import selection


def _valid(value: Column, weight: Column) -> Column:
    return value.isNotNull() & weight.isNotNull() & (weight > 0)


def weighted_pct(value: Column, weight: Column, yes: Sequence[object]) -> Column:
    """Aggregate: weight share (percent) of rows whose value is in `yes`, of rows with value and positive weight; null without any."""
    ok = _valid(value, weight)
    return 100 * F.coalesce(F.sum(F.when(ok & value.isin(*yes), weight)), F.when(F.count_if(ok) > 0, 0.0)) / F.sum(F.when(ok, weight))


def weighted_mean(value: Column, weight: Column) -> Column:
    ok = _valid(value, weight)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def microdata_features(rows: DataFrame, by: Sequence[str], weight: str, shares: Mapping[str, tuple[str, Sequence[object]]], means: Mapping[str, str]) -> DataFrame:
    """One aggregate for all features. shares: name -> (column, yes values); means: name -> column. Adds n_rows."""
    out = [weighted_pct(F.col(c), F.col(weight), yes).alias(n) for n, (c, yes) in shares.items()]
    out += [weighted_mean(F.col(c), F.col(weight)).alias(n) for n, c in means.items()]
    return rows.groupBy(*by).agg(*out, F.count("*").alias("n_rows"))


def total_fertility(rows: DataFrame, by: Sequence[str], age: str, weight: str, births: str, low: int = 15, high: int = 49, years: float = 1.0) -> DataFrame:
    """Sum over single ages of weighted births over weighted women; `years` divides it (1: as is)."""
    ages = rows.where(F.col(age).between(low, high)).groupBy(*by, age).agg((F.sum(F.col(births) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("rate"))
    return ages.groupBy(*by).agg((F.sum("rate") / years).alias("tfr"))


def total_fertility_or_mean(rows: DataFrame, by: Sequence[str], age: str, weight: str, births: str, children: str, low: int = 15, high: int = 49) -> DataFrame:
    """total_fertility where a group has any birth record (`births` not null), else the weighted mean of `children`."""
    w, known = F.col(weight), F.col(children).isNotNull() & (F.col(weight) > 0)
    ages = rows.where(F.col(age).between(low, high)).groupBy(*by, age).agg(
        (F.sum(F.coalesce(births, F.lit(0)) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("rate"), F.count(births).alias("seen"),
        F.sum(F.when(known, F.col(children) * w)).alias("born"), F.sum(F.when(known, w)).alias("women"),
    )
    out = ages.groupBy(*by).agg(F.sum("rate").alias("rate"), F.sum("seen").alias("seen"), F.sum("born").alias("born"), F.sum("women").alias("women"))
    return out.select(*by, F.when(F.col("seen") > 0, F.col("rate")).otherwise(F.col("born") / F.nullif(F.col("women"), F.lit(0.0))).alias("tfr"))


def composite_region(rows: DataFrame, region: str, members: Sequence[str], name: str, totals: Sequence[str], means: Sequence[str], weight: str) -> DataFrame:
    """The table with one more region: sums of totals and `weight`-weighted means of the members."""
    merged = rows.where(F.col(region).isin(*members)).agg(*[F.sum(c).alias(c) for c in totals], *[weighted_mean(F.col(c), F.col(weight)).alias(c) for c in means]).withColumn(region, F.lit(name))
    return rows.unionByName(merged.where(F.col(totals[0]).isNotNull()), allowMissingColumns=True)


def rollup_rates(rows: DataFrame, by: Sequence[str], rates: Mapping[str, tuple[str, str]], code: str) -> DataFrame:
    """Rates from summed numerators and denominators; the code stays only where it is single."""
    made = [(100 * F.sum(n) / F.nullif(F.sum(d), F.lit(0.0))).alias(name) for name, (n, d) in rates.items()]
    return rows.groupBy(*by).agg(*made, F.when(F.count_distinct(code) == 1, F.min(code)).alias(code))


def crosswalk_shares(links: DataFrame, contest: str, zone: str) -> DataFrame:
    """contest, zone, segments, total, share (4 digits)."""
    pairs = links.groupBy(contest, zone).agg(F.count("*").alias("segments"))
    total = F.sum("segments").over(Window.partitionBy(contest))
    return pairs.withColumn("total", total).withColumn("share", F.bround(F.col("segments") / total, 4))


def primary_role(links: DataFrame, contest: str, zone: str) -> DataFrame:
    """Each pair's role: primary (most segments, ties by zone), secondary, unknown (blank zone)."""
    pairs = links.groupBy(contest, zone).agg(F.count("*").alias("segments"))
    blank = F.coalesce(F.trim(zone), F.lit("")) == ""
    place = F.row_number().over(Window.partitionBy(contest).orderBy(blank, F.desc("segments"), zone))
    return pairs.withColumn("role", F.when(blank, "unknown").when(place == 1, "primary").otherwise("secondary"))


def group_actual_shares(results: DataFrame, groups: DataFrame) -> DataFrame:
    """Group share of all votes, for the whole (region null) and each region."""
    sums = results.join(groups, "option", "left").groupBy("region", F.coalesce("group", F.lit("Others")).alias("group")).agg(F.sum("votes").alias("votes"))
    every = sums.unionByName(sums.groupBy("group").agg(F.sum("votes").alias("votes")).withColumn("region", F.lit(None).cast("string")))
    return every.withColumn("share", 100 * F.col("votes") / F.sum("votes").over(Window.partitionBy("region")))


def survey_overall(rows: DataFrame, keys: Sequence[str], kind: str, overall: str, listed: Sequence[str], share: str) -> DataFrame:
    """Mean share of the `overall` rows of a key, else of the listed kinds."""
    own = F.max((F.col(kind) == overall).cast("int")).over(Window.partitionBy(*keys))
    return rows.withColumn("_own", own).where(((F.col("_own") == 1) & (F.col(kind) == overall)) | ((F.col("_own") == 0) & F.col(kind).isin(*listed))).groupBy(*keys).agg(F.avg(share).alias(share))


def correlations(rows: DataFrame, targets: Sequence[str], features: Sequence[str], dead: float = 0.05) -> DataFrame:
    """Pairwise complete Pearson correlations of all pairs from one aggregate; null under 3 pairs or for a constant."""
    aggs = []
    for t in targets:
        for f in features:
            both = F.col(t).isNotNull() & F.col(f).isNotNull()
            x, y = F.when(both, F.col(t).cast("double")), F.when(both, F.col(f).cast("double"))
            aggs.append(F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.count_if(both).alias("n"), F.when((F.count_if(both) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).alias("r")))
    out = rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    return out.withColumn("direction", F.when(F.col("r") > dead, "positive").when(F.col("r") < -dead, "negative").otherwise("near_zero"))


def top_correlates(corr: DataFrame, k: int = 8) -> DataFrame:
    """Per target and sign the k largest by absolute value; ties by feature."""
    signed = corr.where("r <> 0").withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    order = Window.partitionBy("target", "sign").orderBy(F.desc(F.abs("r")), "feature")
    return signed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("target", "sign", "rank", "feature", "r")


def region_coverage(rows: DataFrame, region: str, columns: Sequence[str]) -> DataFrame:
    """Per region: rows, rows with any value, mean share of filled columns, rows without, percent covered (2 digits)."""
    some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns)
    return rows.groupBy(region).agg(F.count("*").alias("rows"), F.count_if(some).alias("covered"), F.avg(filled).alias("mean_filled"), F.count_if(~some).alias("missing"), F.bround(100 * F.count_if(some) / F.count("*"), 2).alias("pct"))


def variable_coverage(rows: DataFrame, region: str, variables: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Per variable: filled rows, percent, regions, most rows filled together with a target; one aggregate."""
    cells = []
    for v in variables:
        joint = [F.count_if(F.col(v).isNotNull() & F.col(t).isNotNull()) for t in targets]
        cells.append(F.struct(F.lit(v).alias("variable"), F.count(v).alias("filled"), (100 * F.count(v) / F.count("*")).alias("pct"), F.count_distinct(F.when(F.col(v).isNotNull(), F.col(region))).alias("regions"), (F.greatest(*joint) if len(joint) > 1 else joint[0]).alias("joint")))
    return rows.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def missing_share(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("missing")) for c in columns]).alias("x")).select(F.inline("x"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def catalog_usage(rows: DataFrame, source: str, variable: str, period: str, contest: str) -> DataFrame:
    """Per source: its variables and periods (sorted) and how many contests."""
    return rows.groupBy(source).agg(F.array_sort(F.collect_set(variable)).alias("variables"), F.array_sort(F.collect_set(period)).alias("periods"), F.count_distinct(contest).alias("contests"))


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each column: number of values, mean, deviation, least and greatest, and exact quartiles (by selection, see there)."""
    number = lambda c: F.col(c).cast("double")
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"), F.min(number(c)).alias("low"), F.max(number(c)).alias("high")) for c in columns]
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns])))
    quartiles = selection.percentiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = rows.agg(F.array(*cells).alias("x")).select(F.inline("x")).join(quartiles, "column", "left")
    return out.select("column", "n", "mean", "sd", "low", "q1", "median", "q3", "high")


def dedupe_by_priority(rows: DataFrame, keys: Sequence[str], value: str, confidence: str, order: Sequence[Column]) -> DataFrame:
    """Best row of each key with n, conflict and status: unique, same_value, highest_confidence or conflict."""
    group = Window.partitionBy(*keys)
    low, high = F.min(value).over(group), F.max(value).over(group)
    top = F.max(confidence).over(group)
    marked = rows.withColumn("n", F.count("*").over(group)).withColumn("conflict", low != high).withColumn("_top", top).withColumn("_place", F.row_number().over(group.orderBy(F.desc(confidence), *order)))
    marked = marked.withColumn("_best", F.sum((F.col(confidence) == F.col("_top")).cast("int")).over(group))
    status = F.when(F.col("n") == 1, "unique").when(~F.col("conflict"), "same_value").when(F.col("_best") == 1, "highest_confidence").otherwise("conflict")
    return marked.where("_place = 1").withColumn("status", status).drop("_top", "_place", "_best")


def duplicate_report(rows: DataFrame, keys: Sequence[str], value: str, source: str) -> DataFrame:
    """Keys of two rows or more: rows, distinct values, sources, recommendation."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("values"), F.array_sort(F.collect_set(source)).alias("sources")).where("n > 1")
    return out.withColumn("advice", F.when(F.col("values") == 1, "keep one").otherwise("review"))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def priority_rank(rows: DataFrame, score: str, name: str) -> DataFrame:
    """1..n by score (falling, nulls last), then name; by range partitions, so no task holds all rows or all scores."""
    return selection.ordered(rows, [], [F.desc_nulls_last(score), F.asc(name)], "rank")


def basic_checks(ranked: DataFrame, expected: int) -> DataFrame:
    """Rows (check, ok, observed, expected) from one aggregate."""
    one = ranked.agg(F.count_if("winner").alias("w"), F.count_distinct("period", "contest").alias("c"), F.count_if((F.col("vote_share") < 0) | (F.col("vote_share") > 100)).alias("b"), F.count_if(F.col("vote_share").isNull()).alias("z"))
    row = lambda n, got, want: F.struct(F.lit(n).alias("check"), (got == want).alias("ok"), got.cast("long").alias("observed"), want.cast("long").alias("expected"))
    return one.select(F.inline(F.array(row("winner count", F.col("w"), F.lit(expected)), row("one winner each", F.col("w"), F.col("c")), row("share bounds", F.col("b"), F.lit(0)), row("null shares", F.col("z"), F.lit(0)))))


def apply_overrides(master: DataFrame, overrides: DataFrame, key: str, variables: Sequence[str], order: str) -> DataFrame:
    """overrides: key, variable, value, allowed, order. The latest valid row of each (key, variable) counts: a null becomes the
    value, an allowed one replaces and keeps <variable>_reference, another goes to <variable>_manual."""
    valid = overrides.where(F.col("value").isNotNull() & F.col(key).isNotNull() & F.col("variable").isin(*variables))
    last = valid.groupBy(key, "variable").agg(F.max(F.struct(order, "value", "allowed")).alias("x"))
    wide = last.groupBy(key).pivot("variable", list(variables)).agg(F.first("x"))
    out = master.join(wide.select(F.col(key), *[F.col(v).alias(f"_{v}") for v in variables]), key, "left")
    for v in variables:
        o = F.col(f"_{v}")
        takes = o.isNotNull() & (F.col(v).isNull() | o["allowed"])
        out = out.withColumns({f"{v}_reference": F.when(takes & F.col(v).isNotNull(), F.col(v)), f"{v}_manual": F.when(o.isNotNull() & ~takes, o["value"]), f"{v}_source": F.when(takes, "manual").when(F.col(v).isNotNull(), "generated").otherwise("none"), v: F.when(takes, o["value"]).otherwise(F.col(v))})
    return out.drop(*[f"_{v}" for v in variables])


def template_rows(master: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """One row for each contest and missing variable."""
    missing = F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in variables]))
    return master.select(key, F.explode(missing).alias("variable"))


def contest_coverage(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    have = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return rows.select(key, have.cast("long").alias("available"), (F.lit(len(columns)) - have).cast("long").alias("missing"), (have > 0).alias("any"))


def alias_upsert(aliases: DataFrame, repairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repairs replace rows of their key and add new ones."""
    return aliases.join(repairs.select(*key).distinct(), list(key), "left_anti").unionByName(repairs)


def alias_coverage(spine: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: keys of the spine, how many have an alias before and after a repair, and their shares."""
    rows = spine.select(key, F.lit(1).alias("s")).unionByName(before.select(key, F.lit(2).alias("s"))).unionByName(after.select(key, F.lit(4).alias("s")))
    kinds = rows.groupBy(key).agg(F.bit_or("s").alias("s")).where(F.col("s").bitwiseAND(1) > 0)
    has = lambda bit: F.count_if(F.col("s").bitwiseAND(bit) > 0)
    out = kinds.agg(F.count("*").alias("keys"), has(2).alias("before"), has(4).alias("after"))
    return out.withColumns({f"{c}_pct": 100 * F.col(c) / F.nullif(F.col("keys"), F.lit(0)) for c in ("before", "after")})


# area panels


def change_pairs(panel: DataFrame, keys: Sequence[str], survey: str, old: object, new: object, features: Sequence[str], years: float = 5.0) -> DataFrame:
    """Two rounds side by side: value of both, change and yearly change where both are there, has_old, has_new, quality."""
    at = lambda s, c: F.max(F.when(F.col(survey) == s, F.col(c)))
    cols = [x for f in features for x in (at(old, f).alias(f"{f}_old"), at(new, f).alias(f"{f}_new"))]
    out = panel.groupBy(*keys).agg(*cols, F.coalesce(F.bool_or(F.col(survey) == old), F.lit(False)).alias("has_old"), F.coalesce(F.bool_or(F.col(survey) == new), F.lit(False)).alias("has_new"))
    for f in features:
        change = F.col(f"{f}_new") - F.col(f"{f}_old")
        out = out.withColumns({f"{f}_change": change, f"{f}_yearly": change / years})
    missing = sum((F.col(f"{f}_change").isNull().cast("int") for f in features), F.lit(0))
    return out.withColumn("quality", F.when(~F.col("has_old") | ~F.col("has_new"), "low").when(missing == 0, "high").otherwise("medium"))


def allocate(links: DataFrame, panel: DataFrame, contest: str, zone: str, features: Sequence[str], by_value: bool = True) -> DataFrame:
    """Weighted mean of zone features for each contest, and coverage (weight of zones that are in the panel).

    by_value: weights are renormalised over the zones that have the value; else over all matched zones.
    """
    matched = F.sum(F.when(F.col("_in"), F.col("share")))
    joined = links.join(panel.withColumn("_in", F.lit(True)), zone, "left")
    out = []
    for f in features:
        weight = F.sum(F.when(F.col(f).isNotNull(), F.col("share"))) if by_value else matched
        out.append((F.sum(F.col(f) * F.col("share")) / F.nullif(weight, F.lit(0.0))).alias(f))
    return joined.groupBy(contest).agg(*out, F.coalesce(matched, F.lit(0.0)).alias("coverage"))
