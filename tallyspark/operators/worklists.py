"""Worklists and diagnostics: validated overrides, progress, priorities, reasons for gaps, autofill, code crosswalks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def override_summary(rows: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """From <variable>_source columns: how many manual fields, and manual, mixed, generated or none."""
    count = lambda s: sum(((F.col(f"{v}_source") == s).cast("int") for v in variables), F.lit(0))
    manual, made = count("manual"), count("generated")
    kind = F.when((manual > 0) & (made > 0), "mixed").when(manual > 0, "manual").when(made > 0, "generated").otherwise("none")
    return rows.select(key, manual.cast("long").alias("manual_fields"), kind.alias("source_type"))


def validate_overrides(rows: DataFrame, key: str, variables: Sequence[str], sources: Sequence[str], low: float, high: float, order: str) -> DataFrame:
    """Adds issues and status by precedence: invalid (unknown variable, no number, out of bounds), duplicate (a later row of the
    same key, variable and source), incomplete (no source), valid."""
    place = F.row_number().over(Window.partitionBy(key, "variable", *sources).orderBy(order))
    checks = [("unknown_variable", ~F.col("variable").isin(*variables)), ("no_value", F.col("value").isNull()), ("out_of_bounds", (F.col("value") < low) | (F.col("value") > high)), ("no_source", F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in sources]).isNull()), ("duplicate", F.col("_n") > 1)]
    out = rows.withColumn("_n", place).withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])))
    has = lambda *names: F.arrays_overlap("issues", F.array(*map(F.lit, names)))
    status = F.when(has("unknown_variable", "no_value", "out_of_bounds"), "invalid").when(has("duplicate"), "duplicate").when(has("no_source"), "incomplete").otherwise("valid")
    return out.withColumn("status", status).drop("_n")


def progress(master: DataFrame, region: str, variables: Sequence[str]) -> DataFrame:
    """Per region: contests, complete ones, filled cells, percent of cells."""
    filled = sum((F.col(v).isNotNull().cast("int") for v in variables), F.lit(0))
    return master.groupBy(region).agg(F.count("*").alias("contests"), F.count_if(filled == len(variables)).alias("complete"), F.sum(filled).alias("cells"), (100 * F.sum(filled) / (len(variables) * F.count("*"))).alias("pct"))


def contest_progress(master: DataFrame, manual: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """manual: key, variable, confidence, valid. Per contest: manual_fields, completed (filled or entered variables), missing (joined
    by ;), confidence (level:count, by level) and needs_review (an entry is not valid)."""
    mine = manual.withColumn("_c", F.nullif(F.lower(F.trim("confidence")), F.lit("")))
    levels = mine.where("_c is not null").groupBy(key, "_c").agg(F.count("*").alias("_n")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_c", "_n"))), ", ").alias("_levels"))
    per = mine.groupBy(key).agg(F.count("*").alias("_fields"), F.coalesce(F.bool_or(~F.col("valid")), F.lit(False)).alias("_odd"), *[F.count_if(F.col("variable") == v).alias(f"_m_{v}") for v in variables])
    out = master.join(per, key, "left").join(levels, key, "left")
    has = {v: F.col(v).isNotNull() | (F.coalesce(f"_m_{v}", F.lit(0)) > 0) for v in variables}
    missing = F.array_join(F.array_compact(F.array(*[F.when(~has[v], F.lit(v)) for v in variables])), ";")
    completed = sum((has[v].cast("int") for v in variables), F.lit(0))
    return out.select(key, F.coalesce("_fields", F.lit(0)).alias("manual_fields"), completed.alias("completed"), missing.alias("missing"), F.coalesce("_levels", F.lit("")).alias("confidence"), F.coalesce("_odd", F.lit(False)).alias("needs_review"))


def variable_progress(contests: DataFrame, manual: DataFrame, variables: Sequence[str]) -> DataFrame:
    """contests: of `contest_progress`. Per variable: contests needed and satisfied, values entered, valid ones, percent satisfied."""
    open_ = F.split("missing", ";")
    done = contests.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), (~F.array_contains(open_, v)).alias("_has")) for v in variables])).alias("x")).select("x.*")
    done = done.groupBy("variable").agg(F.count("*").alias("needed"), F.count_if("_has").alias("satisfied"))
    got = manual.groupBy("variable").agg(F.count("*").alias("entered"), F.count_if("valid").alias("valid"))
    out = done.join(got, "variable", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("entered", "valid")})
    return out.withColumn("pct", 100 * F.col("satisfied") / F.col("needed"))


def expand_batch(batch: DataFrame, manual: DataFrame, key: str, missing: str) -> DataFrame:
    """One row for each variable in the list `missing` (joined by ;) of a contest that has no entry of it in `manual`."""
    rows = batch.where(F.col(missing) != "").select(key, F.explode(F.split(missing, ";")).alias("variable"))
    return rows.join(manual.select(key, "variable").distinct(), [key, "variable"], "left_anti")


def worklist(rows: DataFrame, key: str, region: str, variables: Sequence[str], hot: Column, gap: int = 10) -> DataFrame:
    """Category of each contest (no_data, partial, complete), hot flag, gaps of its region and priority 1 to 3."""
    filled = sum((F.col(v).isNotNull().cast("int") for v in variables), F.lit(0))
    category = F.when(filled == 0, "no_data").when(filled < len(variables), "partial").otherwise("complete")
    out = rows.select(key, region, category.alias("category"), F.coalesce(hot, F.lit(False)).alias("hot"))
    gaps = F.count_if(F.col("category") != "complete").over(Window.partitionBy(region))
    score = F.when(F.col("category") == "no_data", 2).when(F.col("category") == "partial", 1).otherwise(0) + F.col("hot").cast("int") + (F.col("gaps") >= gap).cast("int")
    return out.withColumn("gaps", gaps).withColumn("priority", F.when(F.col("category") == "complete", 3).when(score >= 3, 1).otherwise(2))


def batch(work: DataFrame, n: int, score: Column, key: str) -> DataFrame:
    return work.withColumn("score", score).orderBy(F.desc("score"), key).limit(n)


def alias_repair(work: DataFrame, master: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Class of each name: known, alias_duplicate (its alias target is in the master), reference_old_name, unknown. aliases: source, target."""
    known = master.select(F.col(key).alias("_k")).distinct()
    out = work.join(known, F.col(key) == F.col("_k"), "left").withColumn("_own", F.col("_k").isNotNull()).drop("_k")
    out = out.join(aliases.select(F.col("source").alias("_s"), F.col("target").alias("_t")), F.col(key) == F.col("_s"), "left").drop("_s")
    out = out.join(known, F.col("_t") == F.col("_k"), "left")
    kind = F.when(F.col("_own"), "known").when(F.col("_k").isNotNull(), "alias_duplicate").when(F.col("_t").isNotNull(), "reference_old_name").otherwise("unknown")
    return out.withColumn("kind", kind).withColumn("clean", F.when(F.col("_own"), F.col(key)).otherwise(F.coalesce("_t", key))).drop("_own", "_t", "_k")


def missing_reasons(contests: DataFrame, links: DataFrame, panel: DataFrame, contest: str, zone: str, value: str) -> DataFrame:
    """Why a contest has no value: no_link, zone_not_in_panel, value_missing, or covered; by the best of its zones."""
    p = panel.select(zone, F.lit(1).alias("_in"), F.col(value).isNotNull().cast("int").alias("_has"))
    best = links.join(p, zone, "left").groupBy(contest).agg(F.max("_in").alias("_in"), F.max("_has").alias("_has"), F.lit(1).alias("_link"))
    out = contests.select(contest).distinct().join(best, contest, "left")
    return out.select(contest, F.when(F.col("_link").isNull(), "no_link").when(F.col("_in").isNull(), "zone_not_in_panel").when(F.col("_has") == 0, "value_missing").otherwise("covered").alias("reason"))


def gap_audit(reasons: DataFrame, regions: DataFrame, contest: str, region: str) -> DataFrame:
    """Per region: contests, gaps, and the most frequent break (ties by name)."""
    rows = reasons.join(regions, contest)
    counts = rows.where("reason <> 'covered'").groupBy(region, "reason").agg(F.count("*").alias("n"))
    top = counts.groupBy(region).agg(F.min(F.struct((-F.col("n")).alias("neg"), "reason"))["reason"].alias("top_break"))
    return rows.groupBy(region).agg(F.count("*").alias("contests"), F.count_if(F.col("reason") != "covered").alias("gaps")).join(top, region, "left")


def zone_gaps(links: DataFrame, panel: DataFrame, aliases: DataFrame, region: str, zone: str, contest: str, values: Sequence[str]) -> DataFrame:
    """links: contest, region, zone; panel: zone, values; aliases: source, target. Per region and zone: contests that use it, where the
    chain breaks (covered; alias_missing: the panel has it under the alias only; value_missing; zone_not_in_panel) and the repair."""
    has = F.max(F.coalesce(*[F.when(F.col(v).isNotNull(), 1) for v in values], F.lit(0)))
    known = panel.where(F.col(zone).isNotNull()).groupBy(F.col(zone).alias("_k")).agg(has.alias("_has"))
    other = aliases.groupBy(F.col("source").alias("_s")).agg(F.min("target").alias("target"))
    used = links.groupBy(region, zone).agg(F.count_distinct(contest).alias("contests"))
    out = used.join(known.select(F.col("_k").alias(zone), F.col("_has").alias("_own")), zone, "left")
    out = out.join(other.withColumnRenamed("_s", zone), zone, "left").join(known.select(F.col("_k").alias("target"), F.col("_has").alias("_other")), "target", "left")
    reason = F.when(F.col("_own") == 1, "covered").when(F.col("_other") == 1, "alias_missing").when(F.coalesce("_own", "_other").isNotNull(), "value_missing").otherwise("zone_not_in_panel")
    out = out.withColumn("reason", reason)
    repair = F.when(F.col("reason") == "alias_missing", F.concat(F.lit("read as "), "target")).when(F.col("reason") == "value_missing", "enter the values").when(F.col("reason") == "zone_not_in_panel", "add the zone or an alias of it")
    return out.select(region, zone, "contests", "reason", F.coalesce(repair, F.lit("none")).alias("repair"))


def catalog_audit(variables: DataFrame, columns: DataFrame) -> DataFrame:
    """variables: variable, source; columns: file, column, stage. Is a variable in a raw or a processed file."""
    found = columns.groupBy(F.col("column").alias("variable")).agg(F.count_if(F.col("stage") == "raw").alias("raw"), F.count_if(F.col("stage") == "processed").alias("processed"))
    out = variables.join(found, "variable", "left")
    return out.select("variable", "source", (F.coalesce("raw", F.lit(0)) > 0).alias("in_raw"), (F.coalesce("processed", F.lit(0)) > 0).alias("in_processed"))


def autofill(targets: DataFrame, links: DataFrame, zones: DataFrame, contest: str, zone: str, variables: Sequence[str]) -> DataFrame:
    """Candidates for missing values only: weighted mean over zones with a value, method, mapped share, confidence."""
    long = zones.select(zone, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("x")).select(zone, "x.*").where("value is not null")
    made = links.join(long, zone).groupBy(contest, "variable").agg((F.sum(F.col("value") * F.col("share")) / F.sum("share")).alias("value"), F.count("*").alias("zones"), F.sum("share").alias("mapped"))
    missing = targets.select(contest, F.explode(F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in variables]))).alias("variable"))
    out = made.join(missing, [contest, "variable"], "left_semi")
    return out.withColumn("method", F.when(F.col("zones") == 1, "zone_proxy").otherwise("weighted")).withColumn("confidence", F.when(F.col("mapped") >= 0.95, "high").when(F.col("mapped") >= 0.6, "medium").otherwise("low"))


def closest_names(targets: DataFrame, names: DataFrame, region: str, threshold: float = 0.6, prefix: int = 5) -> DataFrame:
    """targets, names: region, name. For each target the closest name of its region: region, name, closest, score.

    Names are close that are equal, hold each other, share their first `prefix` letters or have a similarity of at least `threshold`;
    the greatest similarity counts, ties go to the least name. Targets without one have no row.
    """
    from tallyspark.operators import name_pieces, relational

    near = name_pieces.edit_join(targets, names, region, threshold).select(region, F.col("left_name").alias("a"), F.col("right_name").alias("b"))
    pairs = near.unionByName(relational.similar_names(targets, names, region, prefix, prefix)).distinct().withColumn("score", name_pieces.similarity(F.col("a"), F.col("b")))
    best = pairs.groupBy(region, F.col("a").alias("name")).agg(F.min(F.struct((-F.col("score")).alias("neg"), "b")).alias("x"))
    return best.select(region, "name", F.col("x.b").alias("closest"), (-F.col("x.neg")).alias("score"))


def skip_diagnostics(targets: DataFrame, candidates: DataFrame, links: DataFrame, contest: str, variables: Sequence[str]) -> DataFrame:
    """Per contest: missing and filled variables and an action (none, link, source, review)."""
    missing = sum((F.col(v).isNull().cast("int") for v in variables), F.lit(0))
    got = candidates.groupBy(contest).agg(F.count("*").alias("_got"))
    linked = links.select(contest).distinct().withColumn("_link", F.lit(1))
    out = targets.select(contest, missing.cast("long").alias("missing")).join(got, contest, "left").join(linked, contest, "left")
    filled = F.coalesce("_got", F.lit(0))
    return out.select(contest, "missing", filled.alias("filled"), F.when(F.col("missing") == 0, "none").when(F.col("_link").isNull(), "link").when(filled == 0, "source").when(filled < F.col("missing"), "review").otherwise("none").alias("action"))


def skipped_targets(targets: DataFrame, filled: DataFrame, linked: DataFrame, sources: Mapping[str, DataFrame], references: Mapping[str, DataFrame], repairs: DataFrame, region: str, master: str, frontend: str, threshold: float = 0.6) -> DataFrame:
    """Targets (region, name, expected: variables to fill) that an autofill left open, and what to do about each.

    filled: region, name, filled (number of variables); linked: region, name of those with zones; sources and references: name ->
    table (region, name); repairs: region, name, kind (`alias_duplicate`, `reference_old_name` or other). Adds in_<source> for each
    source (is the name in it), closest_<reference> (see `closest_names`), alias (the closest name of the first reference for
    names outside `master`), reason (no_link, no_value, partial) and action. Targets are distinct; null names are in no source.
    """
    key = [region, "name"]
    out = targets.select(*key, "expected").join(filled.select(*key, "filled"), key, "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    out = out.where(F.col("filled") < F.col("expected"))
    for flag, table in {"_linked": linked, **{f"in_{n}": t for n, t in sources.items()}}.items():
        out = out.join(table.select(*key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    for name, table in references.items():
        found = closest_names(out.select(*key), table, region, threshold).select(*key, F.col("closest").alias(f"closest_{name}"))
        out = out.join(found, key, "left")
    out = out.join(repairs.groupBy(*key).agg(F.min("kind").alias("_kind")), key, "left")
    alias = F.when(~F.col(f"in_{master}"), F.col(f"closest_{next(iter(references))}"))
    reason = F.when((F.col("filled") == 0) & ~F.col("_linked"), "no_link").when(F.col("filled") == 0, "no_value").otherwise("partial")
    out = out.withColumns({"alias": alias, "reason": reason})
    action = (
        F.when(F.col("_kind") == "alias_duplicate", "merge_duplicate").when(F.col("_kind") == "reference_old_name", "drop_old_name").when(F.col("alias").isNotNull(), "map_alias")
        .when(F.col("reason") == "no_link", "add_link").when(~F.col(f"in_{master}") & ~F.col(f"in_{frontend}"), "drop_old_name").otherwise("research")
    )
    return out.withColumn("action", action).drop("_linked", "_kind")


def mutual_nearest(left: DataFrame, right: DataFrame, block: str, features: Sequence[str]) -> DataFrame:
    """left: block, code, features; right: block, name, features. Pairs that are each other's nearest (mean absolute difference;
    ties by name and code), with cost and confidence. Rows with a null feature have no partner. Exact (see `spatial`).
    """
    from tallyspark.operators import spatial
    from tallyspark.sources.shared import stored

    def side(df: DataFrame, key: str, role: str) -> DataFrame:
        return df.select(block, F.col(key).alias(role), "point")

    def points(df: DataFrame, key: str) -> DataFrame:
        return stored(df.dropna(subset=[block, *features]).select(block, key, F.array(*[F.col(f).cast("double") for f in features]).alias("point")), "points")

    left, right = points(left, "code"), points(right, "name")

    near = lambda a, b, x, y: spatial.nearest(side(a, x, "a"), side(b, y, "b"), [block], len(features), 1, spatial.mean_difference, spread=len(features))
    of_code = near(left, right, "code", "name").select(block, F.col("a").alias("code"), F.col("b").alias("name"), F.col("distance").alias("cost"))
    of_name = near(right, left, "name", "code").select(block, F.col("a").alias("name"), F.col("b").alias("code"))
    out = of_code.join(of_name, [block, "code", "name"])
    return out.withColumn("confidence", F.when(F.col("cost") < 12, "high").when(F.col("cost") < 25, "medium").otherwise("low"))


def code_crosswalk(codes: DataFrame, names: DataFrame, known: DataFrame, region: str, features: Sequence[str], matched: DataFrame | None = None) -> DataFrame:
    """Names of numbered zones. codes: region, code, features; names: region, zone_code, name; known: region, name, features; matched:
    region, code, name, cost of codes without a rank (as of `mutual_nearest`).

    A code is the rank of a name by zone code in its region. The name counts as the known one of its key (method rank_known; high
    below a cost of 15), else as the least known one that holds it or is held by it without blanks (rank_contained), else as it is
    (rank). Codes beyond the names take their match (feature; high below 12, medium below 25) or stay unmapped. The cost is the mean
    absolute difference of the features that both have. Ranks come from range partitions; containment is an equi-join on the first
    three letters of the contained name (all of a shorter one), looked up at every place of the other.
    """
    from tallyspark.functions.scalars import norm_key
    from tallyspark.operators import selection

    packed = lambda c: F.replace(norm_key(F.col(c)), F.lit(" "), F.lit(""))
    start = lambda c: F.substr(c, F.lit(1), F.lit(3))
    places = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.array(*[F.substr(c, i, F.lit(n)) for n in (1, 2, 3)]))))
    ranked = selection.ordered(names.select(region, "zone_code", F.col("name").alias("ranked_name")), [region], [F.asc("zone_code"), F.asc("ranked_name")], "code")
    ranked = ranked.select(region, F.col("code").cast("int").alias("code"), "ranked_name")
    own = codes.select(region, "code", *[F.col(f).alias(f"_l_{f}") for f in features]).join(ranked, [region, "code"], "left")
    own = own.withColumn("_key", norm_key(F.col("ranked_name")))
    other = known.where(F.col("name").isNotNull()).groupBy(region, norm_key(F.col("name")).alias("_key")).agg(F.min(F.struct("name", *features)).alias("_known"))
    out = own.join(other, [region, "_key"], "left")
    left = out.where("_known is null and ranked_name is not null").select(region, "ranked_name", packed("ranked_name").alias("_a")).distinct().where("_a <> ''")
    right = known.select(region, "name", packed("name").alias("_b")).distinct().where("_b <> ''")
    looked = lambda df, c: df.withColumn("_k", F.explode(places(F.col(c))))
    keyed = lambda df, c: df.withColumn("_k", start(F.col(c)))
    inside = looked(left, "_a").join(keyed(right, "_b"), [region, "_k"]).where(F.contains("_a", F.col("_b"))).select(region, "ranked_name", "name")
    around = looked(right, "_b").join(keyed(left, "_a"), [region, "_k"]).where(F.contains("_b", F.col("_a"))).select(region, "ranked_name", "name")
    held = inside.unionByName(around).groupBy(region, "ranked_name").agg(F.min("name").alias("_held"))
    out = out.join(held, [region, "ranked_name"], "left")
    if matched is None:
        out = out.withColumns({"_match": F.lit(None).cast("string"), "_cost": F.lit(None).cast("double")})
    else:
        out = out.join(matched.select(region, "code", F.col("name").alias("_match"), F.col("cost").alias("_cost")), [region, "code"], "left")
    gaps = F.array_compact(F.array(*[F.abs(F.col(f"_l_{f}") - F.col("_known")[f]).cast("double") for f in features]))
    cost = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(gaps), F.lit(0))
    has, ranks, match = F.col("_known").isNotNull(), F.col("ranked_name").isNotNull(), F.col("_match").isNotNull()
    out = out.withColumn("method", F.when(has, "rank_known").when(F.col("_held").isNotNull(), "rank_contained").when(ranks, "rank").when(match, "feature").otherwise("unmapped"))
    out = out.withColumn("cost", F.when(has, cost).when(F.col("method") == "feature", F.col("_cost")))
    bar = F.when(F.col("method") == "rank_known", 15.0).when(F.col("method") == "feature", 12.0)
    confidence = F.when(F.col("cost") < bar, "high").when(ranks | (F.col("cost") < 25), "medium").otherwise("low")
    return out.select(region, "code", F.coalesce(F.col("_known.name"), "_held", "ranked_name", "_match").alias("name"), "method", "cost", confidence.alias("confidence"))


def region_trends(panel: DataFrame, region: str, survey: str, old: object, new: object, indicators: Mapping[str, int]) -> DataFrame:
    """Newer less older mean of each indicator times its sign (-1: less is better), joined back to the newer rows."""
    at = lambda s, f: F.avg(F.when(F.col(survey) == s, F.col(f)))
    return panel.groupBy(region).agg(*[(sign * (at(new, f) - at(old, f))).alias(f"{f}_trend") for f, sign in indicators.items()])
