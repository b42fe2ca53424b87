"""Survey table curation: label matching, keyword scores, validation, review, curation, poll accuracy; and cell tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_label(rows: DataFrame, label: str, aliases: Mapping[str, str], skip: Sequence[str] = (), patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds `canonical`: the exact alias, else that of the longest alias contained either way (ties: by alias), else that of the
    first of the `patterns` (regular expression, name) that is found; null for skips.

    Aliases are a small rule table; each label is tested by one expression, without a join.
    """
    text = F.lower(F.trim(label))
    exact = F.lit(None).cast("string")
    inside = F.lit(None).cast("string")
    for alias, name in sorted(aliases.items(), key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):  # the last that holds wins
        exact = F.when(text == alias.lower(), name).otherwise(exact)
        inside = F.when(F.contains(text, F.lit(alias.lower())) | ((F.char_length(text) >= 3) & F.contains(F.lit(alias.lower()), text)), name).otherwise(inside)
    found = F.coalesce(exact, inside, *[F.when(text.rlike(p), name) for p, name in patterns])
    return rows.withColumn("canonical", F.when(~text.isin(*[s.lower() for s in skip]), found) if skip else found)


def match_group(rows: DataFrame, label: str, groups: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds group_type and group: of the longest alias contained; aliases of at most 3 letters only as whole words."""
    text = F.lower(F.trim(label))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, (k, g) in sorted(groups.items(), key=lambda x: (len(x[0]), x[0])):
        hit = text.rlike(rf"\b{alias.lower()}\b") if len(alias) <= 3 else F.contains(text, F.lit(alias.lower()))
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, g).otherwise(name)
    return rows.withColumns({"group_type": kind, "group": name})


def keyword_score(docs: DataFrame, text: str, keywords: Mapping[str, tuple[str, int]]) -> DataFrame:
    """keywords: word -> (class, weight). Adds score (sum of weights of contained words), classes and hits (sorted)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(w).alias("w"), F.lit(c).alias("c"), F.lit(p).alias("p"))) for w, (c, p) in sorted(keywords.items())]))
    return docs.withColumn("_f", found).withColumns({
        "score": F.aggregate("_f", F.lit(0), lambda a, x: a + x["p"]),
        "classes": F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["c"]))),
        "hits": F.transform("_f", lambda x: x["w"]),
    }).drop("_f")


def classify_docs(docs: DataFrame, text: str, keywords: Mapping[str, Sequence[str]], guards: Sequence[str] = (), strong: int = 8, weak: int = 4, context: Mapping[str, tuple[Sequence[str], int]] | None = None) -> DataFrame:
    """Adds class (most keyword hits; ties by name; null without), hits and action: accept, review or skip. A guard word skips.

    context: class -> (words, bonus); a class with hits gets the bonus where one of its words stands.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def total(name: str, words: Sequence[str]) -> Column:
        n = sum((F.regexp_count(low, F.lit(w.lower())) for w in words), F.lit(0))
        around, bonus = (context or {}).get(name, ((), 0))
        stands = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in around], F.lit(False))
        return n + F.when((n > 0) & stands, bonus).otherwise(0)

    counts = [F.struct((-total(name, words)).alias("neg"), F.lit(name).alias("name")) for name, words in sorted(keywords.items())]
    best = F.array_min(F.array(*counts))
    guard = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g.lower())) for g in guards], F.lit(False))
    out = docs.withColumn("_b", best)
    hits = -F.col("_b.neg")
    return out.withColumns({"class": F.when(hits > 0, F.col("_b.name")), "hits": hits, "action": F.when(guard, "skip").when(hits >= strong, "accept").when(hits >= weak, "review").otherwise("skip")}).drop("_b")


def validate_rows(rows: DataFrame, share: str, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Adds flags (range, blank_<column>, duplicate, conflict) and status ok, warn or error."""
    group = Window.partitionBy(*keys)
    n, low, high = F.count("*").over(group), F.min(share).over(group), F.max(share).over(group)
    marks = [F.when(F.col(share).isNull() | (F.col(share) < 0) | (F.col(share) > 100), F.lit("range"))]
    marks += [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"blank_{c}")) for c in required]
    marks += [F.when(F.col("_n") > 1, F.lit("duplicate")), F.when(F.col("_low") != F.col("_high"), F.lit("conflict"))]
    out = rows.withColumns({"_n": n, "_low": low, "_high": high}).withColumn("flags", F.array_compact(F.array(*marks)))
    bad = F.array_contains("flags", "range") | F.array_contains("flags", "conflict")
    return out.withColumn("status", F.when(bad, "error").when(F.size("flags") > 0, "warn").otherwise("ok")).drop("_n", "_low", "_high")


def resolve_reviews(rows: DataFrame, reviews: DataFrame, key: str, value: str) -> DataFrame:
    """reviews: key, decision (approve, reject, edit), new_value. Rows that stay, with decision; high confidence needs no review."""
    out = rows.join(reviews.select(key, "decision", "new_value"), key, "left")
    decision = F.coalesce("decision", F.when(F.col("confidence") == "high", "auto_approve"))
    out = out.withColumn("decision", decision).where("decision in ('approve', 'edit', 'auto_approve')")
    return out.withColumn(value, F.when(F.col("decision") == "edit", F.col("new_value")).otherwise(F.col(value))).drop("new_value")


def curate(sources: Sequence[DataFrame], keys: Sequence[str], share: str) -> DataFrame:
    """Sources in order of trust: the first source's most confident row of each key (null keys are keys); conflict, trust label."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("origin", F.lit(k)) for k, s in enumerate(sources)])
    best = every.groupBy(*keys).agg(F.min(F.struct("origin", (-F.col("confidence")).alias("neg"), share)).alias("x"), (F.count_distinct(share) > 1).alias("conflict"))
    trust = F.when(F.col("conflict"), "conflicting").when(F.col("x.origin") == 0, "reviewed").otherwise("extracted")
    return best.select(*keys, F.col("x.origin").alias("origin"), F.col(f"x.{share}").alias(share), "conflict", trust.alias("trust"))


def poll_accuracy(survey: DataFrame, actual: DataFrame, groups: DataFrame) -> DataFrame:
    """survey: region, option, share; actual: region, option, share; groups: option, group. Error of each survey row against its
    option's share, else its group's; direction."""
    a = actual.select("region", "option", F.col("share").alias("own"))
    g = actual.join(groups, "option").groupBy("region", "group").agg(F.sum("share").alias("of_group"))
    rows = survey.join(groups, "option", "left").join(a, ["region", "option"], "left").join(g, ["region", "group"], "left")
    error = F.col("share") - F.coalesce("own", "of_group")
    return rows.select("region", "option", "share", F.coalesce("own", "of_group").alias("actual"), error.alias("error"), F.abs(error).alias("abs_error"), F.when(error > 0, "over").when(error < 0, "under").when(error == 0, "exact").alias("direction"))


def prioritise(rows: DataFrame, score: str, high: float, medium: float) -> DataFrame:
    return rows.withColumn("bucket", F.when(F.col(score) >= high, "high").when(F.col(score) >= medium, "medium").otherwise("low"))


def extract_facts(docs: DataFrame, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each fact the first group of the first pattern that hits."""
    pick = lambda ps: F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")) for p in ps])
    return docs.withColumns({name: pick(ps) for name, ps in patterns.items()})


def header_rows(cells: DataFrame, keywords: Sequence[str], filled: float = 0.6, within: int = 15) -> DataFrame:
    """cells: file, row, col, value. Per file its header row: the first of `within` rows with enough filled cells, no number and
    a keyword; else 0."""
    number = F.trim("value").try_cast("double").isNotNull()
    some = F.coalesce(F.trim("value"), F.lit("")) != ""
    word = F.lower("value").rlike("|".join(k.lower() for k in keywords))
    per = cells.where(F.col("row") < within).groupBy("file", "row").agg((F.count_if(some) / F.count("*")).alias("share"), F.coalesce(F.bool_or(number), F.lit(False)).alias("numbers"), F.coalesce(F.bool_or(word), F.lit(False)).alias("hit"))
    found = per.where((F.col("share") >= filled) & ~F.col("numbers") & F.col("hit")).groupBy("file").agg(F.min("row").alias("row"))
    return cells.select("file").distinct().join(found, "file", "left").withColumn("row", F.coalesce("row", F.lit(0)))


def unpivot_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Long rows (file, label, option, value) of wide survey tables: header cells name options, the first column labels rows."""
    h = headers.select("file", F.col("row").alias("h"))
    rows = cells.join(h, "file")
    head = rows.where("row = h and col > 0").select("file", "col", F.trim("value").alias("option"))
    label = rows.where("row > h and col = 0").select("file", "row", F.trim("value").alias("label"))
    body = rows.where("row > h and col > 0").select("file", "row", "col", F.regexp_replace("value", "%", "").try_cast("double").alias("value"))
    return body.join(head, ["file", "col"]).join(label, ["file", "row"]).select("file", "label", "option", "value")


def table_inventory(cells: DataFrame, words: Sequence[str]) -> DataFrame:
    """Per file: cells, numbers, percent cells, cells with a word."""
    number = F.trim("value").try_cast("double").isNotNull()
    return cells.groupBy("file").agg(F.count("*").alias("cells"), F.count_if(number).alias("numbers"), F.count_if(F.contains("value", F.lit("%"))).alias("percents"), F.count_if(F.lower("value").rlike("|".join(w.lower() for w in words))).alias("words"))
