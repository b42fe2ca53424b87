"""Contest profiles: rule tags, additive priorities, field-wise overrides of generated notes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import norm_key, null_tokens, pad_code, ratio

POINTS = (("flipped", 30), ("close", 25), ("volatile", 20))


def key_factors(close: float = 5.0, fragmented: float = 10.0, volatile: float = 3.0) -> Column:
    """Tags of the rules that hold, in rule order."""
    rules = (("flipped", F.col("flipped")), ("close", F.col("top2_margin_pct") <= close), ("fragmented", F.col("effective_options") > fragmented), ("volatile", F.col("mean_abs_swing") > volatile))
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


def priority_contests(scores: DataFrame, top: int = 25, review: int = 30, count_repeats: bool = True) -> DataFrame:
    """Additive priority: points of every reason a contest has (repeats add again unless count_repeats is off), reasons, review."""
    lists = {
        "flipped": scores.where("flipped"),
        "close": scores.where("top2_margin_pct is not null").orderBy("top2_margin_pct", "contest").limit(top),
        "volatile": scores.where("score is not null").orderBy(F.desc("score"), "contest").limit(top),
    }
    parts = [lists[n].select("contest", F.lit(k).alias("k"), F.lit(n).alias("reason"), F.lit(p).alias("points")) for k, (n, p) in enumerate(POINTS)]
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows if count_repeats else rows.distinct()
    out = rows.groupBy("contest").agg(F.sum("points").alias("points"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("k", "reason"))), lambda x: x["reason"])).alias("reasons"))
    return out.withColumn("review", F.col("points") >= review)


def profile_tags(options: Sequence[str] = ("a", "b"), close: float = 5.0, large: float = 10.0, turnout: float = 5.0, covered: tuple[float, float] = (0.5, 0.75)) -> Column:
    """Tags of the rules that hold, in rule order, from flipped, margin, swing_<option>, turnout_change or both turnouts, urban,
    coverage, quality and zones_missing. The defaults are fixed values."""
    change = F.coalesce("turnout_change", F.col("turnout_curr") - F.col("turnout_prev"))
    rules = [("flip", F.col("flipped")), ("close", F.col("margin") <= close)]
    for o in options:
        rules += [(f"large_gain_{o}", F.col(f"swing_{o}") >= large), (f"large_loss_{o}", F.col(f"swing_{o}") <= -large)]
    rules += [("turnout_shift", F.abs(change) >= turnout), ("urban", F.col("urban") >= 50), ("rural", F.col("urban") < 30), ("well_covered", F.col("coverage") >= covered[1]), ("thinly_covered", F.col("coverage") < covered[0])]
    rules += [("results_only", F.col("quality") == "election_only"), ("zones_missing", F.col("zones_missing") != "")]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


#: Points of each reason.
REASONS = {"flip": 30, "close": 25, "gain": 20, "loss": 20, "major": 15}


def priority_list(rows: DataFrame, majors: DataFrame, listed: DataFrame | None = None, options: Sequence[str] = ("a", "b"), top: int = 25, review: int = 30) -> DataFrame:
    """rows: contest, flipped, margin, swing_<option>. Every contest with a reason: points, reasons, rank and review.

    Flips, majors (contest), the `top` closest and each option's `top` gains and losses give points; `listed` (contest, reason) are
    published lists, whose reasons add their points again.
    """
    reason = lambda df, name: df.select("contest", F.lit(name).alias("reason"))
    first = lambda c, down: rows.where(F.col(c).isNotNull()).orderBy(F.desc(c) if down else F.asc(c), "contest").limit(top)
    parts = [reason(rows.where("flipped"), "flip"), reason(rows.join(majors.select("contest").distinct(), "contest", "left_semi"), "major"), reason(first("margin", False), "close")]
    for o in options:
        parts += [reason(first(f"swing_{o}", True), f"gain_{o}"), reason(first(f"swing_{o}", False), f"loss_{o}")]
    every = reduce(DataFrame.unionByName, parts if listed is None else [*parts, listed.select("contest", "reason")])
    worth = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.get(F.split("reason", "_"), F.lit(0)))
    out = every.groupBy("contest").agg(F.sum(worth).alias("points"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    # points are sums of a few values: a window over them sees a row for each sum
    sums = out.groupBy("points").agg(F.count("*").alias("n"))
    above = sums.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("points")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("points").orderBy("contest"))
    return out.join(F.broadcast(above), "points").select("contest", "points", "reasons", (F.col("above") + place).alias("rank"), (F.col("points") >= review).alias("review"))


def rank_flags(rows: DataFrame, priority: DataFrame, options: Sequence[str] = ("a", "b"), close: float = 5.0, large: float = 10.0) -> DataFrame:
    """Booleans of each contest: flipped, close, large gain and loss of each option, on the priority list; unknown is false."""
    tests = {"is_flipped": F.col("flipped"), "is_close": F.col("margin") <= close}
    for o in options:
        tests |= {f"is_large_gain_{o}": F.col(f"swing_{o}") >= large, f"is_large_loss_{o}": F.col(f"swing_{o}") <= -large}
    out = rows.join(priority.select("contest", F.lit(True).alias("is_priority")), "contest", "left")
    return out.select("contest", *[F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()], F.coalesce("is_priority", F.lit(False)).alias("is_priority"))


def merge_notes(generated: DataFrame, manual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field-wise: a manual text that is not blank goes first; source says manual, mixed or generated."""
    own = manual.select(key, *[null_tokens(F.col(f)).alias(f"_{f}") for f in fields])
    out = generated.join(own, key, "left")
    used = sum((F.col(f"_{f}").isNotNull().cast("int") for f in fields), F.lit(0))
    source = F.when(used == len(fields), "manual").when(used > 0, "mixed").otherwise("generated")
    return out.withColumn("source", source).withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def contest_profile(scores: DataFrame) -> DataFrame:
    """Tags, a text of the facts that hold, confidence (none of the parts missing) and quality."""
    tags = key_factors()
    text = F.concat_ws(
        " ",
        F.when(F.col("flipped"), F.concat(F.lit("Moved from "), "prev_winner", F.lit(" to "), "curr_winner", F.lit("."))).otherwise(F.concat(F.lit("Held by "), "curr_winner", F.lit("."))),
        F.when(F.col("top2_margin_pct") <= 5, F.lit("The margin is narrow.")),
    )
    whole = F.col("top2_margin_pct").isNotNull() & F.col("mean_abs_swing").isNotNull()
    return scores.select("contest", tags.alias("tags"), text.alias("text"), F.when(whole, "high").otherwise("low").alias("confidence"), F.when(F.col("score").isNotNull(), "complete").otherwise("partial").alias("quality"))


def profile_sections(rows: DataFrame, options: Sequence[str] = ("a", "b")) -> DataFrame:
    """rows: those of `profile_tags` with region, prev_winner and curr_winner. Per contest one text for each section, confidence and
    the columns that the texts rest on. A section whose facts are unknown says so; points are rounded half up."""
    points = lambda c: F.floor(F.abs(c) + 0.5).cast("string")
    change = F.coalesce("turnout_change", F.col("turnout_curr") - F.col("turnout_prev"))
    moved = [F.when(F.abs(F.col(f"swing_{o}")) >= 0.5, F.concat(F.lit(f"{o} "), F.when(F.col(f"swing_{o}") > 0, "gains ").otherwise("loses "), points(F.col(f"swing_{o}")), F.lit(" points."))).when(F.col(f"swing_{o}").isNotNull(), f"{o} holds its share.") for o in options]
    turnout = F.when(change > 0, "Turnout rises.").when(change < 0, "Turnout falls.").when(change == 0, "Turnout is unchanged.")
    said = lambda text, unknown: F.coalesce(F.nullif(text, F.lit("")), F.lit(unknown))
    sections = {
        "summary": said(F.when(F.col("flipped"), F.concat("region", F.lit(": from "), "prev_winner", F.lit(" to "), "curr_winner", F.lit("."))).otherwise(F.concat("region", F.lit(": held by "), "curr_winner", F.lit("."))), "No winner is known."),
        "movement": said(F.concat_ws(" ", *moved, turnout), "No change is known."),
        "population": F.when(F.col("urban") >= 50, "Mostly urban.").when(F.col("urban") < 30, "Mostly rural.").when(F.col("urban").isNotNull(), "Town and country.").otherwise("No area data."),
        "zones": F.concat_ws(" ", said(F.concat(F.lit("Zones cover "), points(100 * F.col("coverage")), F.lit(" percent.")), "No zone is linked."), F.when(F.col("zones_missing") != "", F.concat(F.lit("Without data: "), "zones_missing", F.lit(".")))),
        "watch": said(F.concat_ws(" ", F.when(F.col("margin") <= 5, F.concat(F.lit("The margin is "), points(F.col("margin")), F.lit(" points."))), F.when(F.col("flipped"), "The seat is new to its holder."), F.when(F.abs(change) >= 5, "Turnout moves.")), "Nothing stands out."),
    }
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("curr_winner", "margin", *[f"swing_{o}" for o in options])])
    confidence = F.when(~whole, "low").when(F.col("quality") == "high", "high").otherwise("medium")
    facts = ["prev_winner", "curr_winner", "margin", *[f"swing_{o}" for o in options], "turnout_prev", "turnout_curr", "urban", "coverage", "zones_missing"]
    return rows.select("contest", *[t.alias(n) for n, t in sections.items()], confidence.alias("confidence"), "quality", F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in facts]).alias("facts"))


def review_report(notes: DataFrame, key: str, fields: Sequence[str], least: int = 20) -> DataFrame:
    """has_manual, review needed and why: blank fields, and texts shorter than `least` characters."""
    why = [F.when(null_tokens(F.col(f)).isNull(), F.lit(f"blank {f}")).when(F.char_length(f) < least, F.lit(f"short {f}")) for f in fields]
    out = notes.select(key, F.col("source").isin("manual", "mixed").alias("has_manual"), F.array_compact(F.array(*why)).alias("reasons"))
    return out.select(key, "has_manual", (F.size("reasons") > 0).alias("review"), F.array_join("reasons", "; ").alias("reasons"))


def insight_flags(features: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """rules: (statement, column, '>' or '<', bound). Adds `insights`: the statements that hold, in rule order."""
    holds = [F.when(F.col(c) > b if op == ">" else F.col(c) < b, F.lit(text)) for text, c, op, b in rules]
    return features.withColumn("insights", F.array_compact(F.array(*holds)))


def region_bridge(outcomes: DataFrame, facts: DataFrame, region: str, composites: DataFrame, legacy: DataFrame) -> DataFrame:
    """Region outcomes with facts and how they were found: exact, composite, legacy or none.

    composites, legacy: region -> other (the name under which the facts have it); each is tried where those before fail.
    """
    value = [c for c in facts.columns if c != region]
    f = lambda n: facts.select(F.col(region).alias(f"_k{n}"), *[F.col(c).alias(f"_{c}{n}") for c in value])
    out = outcomes.join(composites.select(region, F.col("other").alias("_k2")), region, "left").join(legacy.select(region, F.col("other").alias("_k3")), region, "left").withColumn("_k1", F.col(region))
    for n in (1, 2, 3):
        out = out.join(f(n).withColumn(f"_hit{n}", F.lit(True)), f"_k{n}", "left")
    status = F.when(F.col("_hit1"), "exact").when(F.col("_hit2"), "composite").when(F.col("_hit3"), "legacy").otherwise("none")
    pick = lambda c: F.when(F.col("_hit1"), F.col(f"_{c}1")).when(F.col("_hit2"), F.col(f"_{c}2")).when(F.col("_hit3"), F.col(f"_{c}3"))
    return out.select(*outcomes.columns, *[pick(c).alias(c) for c in value], status.alias("match"))


def reassign_region(rows: DataFrame, region: str, zone: str, moves: DataFrame) -> DataFrame:
    """moves: zone, new_region. Zones that moved get their new region; the former stays as <region>_old."""
    out = rows.join(moves.select(F.col("zone").alias(zone), "new_region"), zone, "left")
    return out.withColumn(f"{region}_old", F.col(region)).withColumn(region, F.coalesce("new_region", region)).drop("new_region")


def coded_totals(raw: DataFrame, code: str, level: str, levels: Sequence[str], values: Sequence[str], size: int) -> DataFrame:
    """District totals from coded raw rows: padded code, the named levels as columns <level>_<value>, share of the first level."""
    wide = raw.groupBy(pad_code(F.col(code), size).alias(code)).agg(*[F.sum(F.when(F.col(level) == lv, F.col(v))).alias(f"{lv}_{v}") for lv in levels for v in values])
    rates = {f"{lv}_{v}_pct": ratio(F.col(f"{lv}_{v}"), F.col(f"{levels[0]}_{v}")) for lv in levels[1:] for v in values}
    return wide.withColumns(rates)


def moved_region(rows: DataFrame, region: str, zone: str, moves: DataFrame | None) -> DataFrame:
    """Adds region_key and zone_key; moves: region_key, zone_key, new_region of the zones that went to another region."""
    out = rows.withColumn("region_key", norm_key(F.col(region))).withColumn("zone_key", norm_key(F.col(zone)))
    if moves is None:
        return out
    out = out.join(moves.select("region_key", "zone_key", "new_region"), ["region_key", "zone_key"], "left")
    return out.withColumn(region, F.coalesce("new_region", region)).withColumn("region_key", norm_key(F.col(region))).drop("new_region")


def zone_areas(files: Sequence[DataFrame], region: str, zone: str, area: str, moves: DataFrame | None = None) -> DataFrame:
    """Area of each zone from tables in order of priority; rows without an area above 0 go. Of the rows of a zone the first table's
    counts, there the least name and area. Adds source: the table's place."""
    rows = reduce(DataFrame.unionByName, [f.select(region, zone, F.col(area).cast("string").try_cast("double").alias(area), F.lit(k).alias("source")) for k, f in enumerate(files)])
    keyed = moved_region(rows.where(F.col(area) > 0), region, zone, moves)
    best = keyed.groupBy("region_key", "zone_key").agg(F.min(F.struct("source", zone, region, area)).alias("b"))
    return best.select("region_key", "zone_key", *[F.col("b")[c].alias(c) for c in (region, zone, area, "source")])


def zone_composition(raw: DataFrame, names: DataFrame, region_code: str, zone_code: str, lower: Sequence[str], kind: str, total: str, groups: Sequence[str], region: str, zone: str, sizes: tuple[int, int] = (2, 3), moves: DataFrame | None = None) -> DataFrame:
    """Counts of `groups` and their percent of `total` for each zone, from the coded rows that stand for a whole zone: zone code set,
    `lower` codes blank or 0, kind Total, total known. names: both codes, region, zone; zones without a name go. Of the rows of a
    zone the one with the least numbers counts."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).rlike("^0*([.]0)?$")
    keep = reduce(Column.__and__, [empty(c) for c in lower], ~empty(zone_code) & (F.trim(kind) == "Total"))
    number = lambda c: F.col(c).cast("string").try_cast("double").alias(c)
    codes = lambda: (pad_code(F.col(region_code), sizes[0]).alias("_r"), pad_code(F.col(zone_code), sizes[1]).alias("_z"))
    rows = raw.where(keep).select(*codes(), number(total), *[number(g) for g in groups]).where(F.col(total).isNotNull())
    named = names.where(F.coalesce(F.trim(zone), F.lit("")) != "").groupBy(*codes()).agg(F.min(F.struct(region, zone)).alias("n")).select("_r", "_z", "n.*")
    keyed = moved_region(rows.join(named, ["_r", "_z"]), region, zone, moves)
    best = keyed.groupBy("region_key", "zone_key").agg(F.min(F.struct(total, *groups, region, zone)).alias("b"))
    out = best.select("region_key", "zone_key", *[F.col("b")[c].alias(c) for c in (region, zone, total, *groups)])
    return out.withColumns({f"{g}_pct": ratio(F.col(g), F.col(total)) for g in groups})


def zone_master(zones: DataFrame, name: str, sources: Sequence[DataFrame], values: Sequence[str]) -> DataFrame:
    """One row for each zone: id (slug of its name), name, and each value from the first source that has it (each source: the
    name column and some of `values`). Zones of one id are merged under the least name."""
    from tallyspark.functions.scalars import slug

    rows = [zones.select(F.col(name), F.lit(0).alias("_p"), *[F.lit(None).cast("double").alias(v) for v in values])]
    for k, source in enumerate(sources, 1):
        rows.append(source.select(F.col(name), F.lit(k).alias("_p"), *[(F.col(v).cast("double") if v in source.columns else F.lit(None).cast("double")).alias(v) for v in values]))
    every = reduce(DataFrame.unionByName, rows).withColumn("zone_id", slug(F.col(name)))
    best = [F.min(F.when(F.col(v).isNotNull(), F.struct("_p", v)))[v].alias(v) for v in values]
    out = every.groupBy("zone_id").agg(F.min(F.when(F.col("_p") == 0, F.col(name))).alias(name), *best)
    return out.where(F.col(name).isNotNull())


def region_census(files: Sequence[DataFrame], key: str, level: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Totals of each key by level, from long tables (key, level, value) in order of priority, and the levels' share of the first.

    One aggregate over the union: of the files that have a level of a key, the first one's sum counts.
    """
    rows = reduce(DataFrame.unionByName, [f.select(key, level, value, F.lit(k).alias("_p")) for k, f in enumerate(files)])
    sums = rows.where(F.col(level).isin(*levels)).groupBy(key, level, "_p").agg(F.sum(value).alias(value)).where(F.col(value).isNotNull())
    first = [F.min(F.when(F.col(level) == lv, F.struct("_p", value)))[value].alias(lv) for lv in levels]
    out = sums.groupBy(key).agg(*first)
    return out.withColumns({f"{lv}_pct": 100 * F.col(lv) / F.nullif(F.col(levels[0]), F.lit(0)) for lv in levels[1:]})
