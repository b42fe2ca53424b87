"""Projections, filters, top lists, joins with fallbacks, set operations and reshaping on any table."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import name_pieces, spatial

#: A side is broadcast by hint only where its rows are counted and at most this many; else Spark chooses the join.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


# projections and predicates


def clean_column_names(df: DataFrame, replace: bool = False) -> DataFrame:
    """Lower-case names, blanks to `_`, other signs deleted (or replaced by `_`)."""
    clean = lambda n: re.sub(r"[^0-9a-z_]+", "_" if replace else "", re.sub(r"\s+", "_", n.strip().lower())).strip("_")
    return df.toDF(*map(clean, df.columns))


def rename_by_alias(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """canonical -> spellings, best first: the first that exists gets the canonical name."""
    found = {next(s for s in spellings if s in df.columns): name for name, spellings in aliases.items() if name not in df.columns and any(s in df.columns for s in spellings)}
    return df.withColumnsRenamed(found)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def project_existing(df: DataFrame, preferred: Sequence[str], rest: bool = True) -> DataFrame:
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if rest and c not in first])


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c]])


def closest(df: DataFrame, margin: str, n: int, where: Column | None = None, ties: str = "contest") -> DataFrame:
    rows = df.where(F.col(margin).isNotNull())
    return (rows if where is None else rows.where(where)).orderBy(margin, ties).limit(n)


def greatest_by(df: DataFrame, measure: str, n: int, ties: str = "contest") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), ties).limit(n)


def search(df: DataFrame, text: str, columns: Sequence[str], equal: Mapping[str, str] | None = None, within: DataFrame | None = None, key: str = "contest") -> DataFrame:
    """Rows with `text` in one of the columns in either case, equal values in either case, and keys of another table."""
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])
    for c, v in (equal or {}).items():
        hit = hit & (F.lower(c) == v.lower())
    rows = df.where(hit)
    return rows if within is None else rows.join(within.select(key).distinct(), key, "left_semi")


def detail(df: DataFrame, key: str, nested: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Each row with one sorted array of structs for each nested table (name -> (table with the key, columns))."""
    for name, (other, columns) in nested.items():
        df = df.join(other.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), key, "left")
    return df


def exclude_options(df: DataFrame, names: Sequence[str] = ("NOTA", "NONE", ""), column: str = "option") -> DataFrame:
    return df.where(~F.coalesce(F.col(column), F.lit("")).isin(*names))


def field_catalog(df: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """For each named field: group, rows with a value, all rows; from one aggregate."""
    fields = [F.struct(F.lit(c).alias("field"), F.lit(g).alias("group"), F.count(c).alias("filled"), F.count("*").alias("rows")) for c, g in groups.items()]
    return df.agg(F.array(*fields).alias("x")).select(F.inline("x"))


def points_for_region(points: DataFrame, region: str, x: str, y: str) -> DataFrame:
    """Points whose region contains the name's first word, all if none does; x and y scaled to 0..100."""
    word = region.split()[0].lower() if region.split() else ""
    near = points.withColumn("near", F.contains(F.lower("region"), F.lit(word)))
    hits = near.agg(F.coalesce(F.bool_or("near"), F.lit(False))).scalar()
    chosen = near.where(F.col("near") | ~hits).drop("near")
    span = chosen.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))])
    scaled = {c: (F.col(c) - span.select(f"low_{c}").scalar()) / F.nullif(span.select(f"high_{c}").scalar() - span.select(f"low_{c}").scalar(), F.lit(0.0)) * 100 for c in (x, y)}
    return chosen.withColumns(scaled)


# joins


def enrich(df: DataFrame, dim: DataFrame, key: str, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join of a dimension with default values."""
    out = df.join(dim, key, "left")
    return out.fillna(dict(fill)) if fill else out


def attach_facts(df: DataFrame, facts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns overwritten by `facts` where it has a value."""
    renamed = facts.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def alias_key(df: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """aliases: source, target. Replaces the key by its target and keeps the source as <key>_source."""
    renamed = aliases.select(F.col("source").alias(key), F.col("target").alias("_target"))
    return df.join(renamed, key, "left").withColumn(f"{key}_source", F.col(key)).withColumn(key, F.coalesce("_target", key)).drop("_target")


def multi_left_join(spine: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    return reduce(lambda left, t: left.join(t[0], list(t[1]), "left"), tables, spine)


def fallback_join(df: DataFrame, dim: DataFrame, candidates: Sequence[Column], dim_key: str, row_id: str) -> DataFrame:
    """Tries the candidate keys in order; the first with a row in `dim` wins. Adds the dimension's columns and `matched_by`."""
    tries = df.select(row_id, F.posexplode(F.array(*candidates)).alias("matched_by", dim_key))
    hits = tries.join(dim, dim_key)
    best = hits.groupBy(row_id).agg(F.min(F.struct("matched_by", *[c for c in dim.columns])).alias("x")).select(row_id, "x.*")
    return df.join(best, row_id, "left")


def coalesce_join(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], columns: Sequence[str], priority: Column | None = None, how: str = "left") -> DataFrame:
    """Nulls of primary filled from secondary; rows of `priority` take secondary's value first."""
    other = secondary.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = primary.join(other, list(keys), how)
    pick = lambda c: F.coalesce(c, f"_{c}") if priority is None else F.when(priority, F.coalesce(f"_{c}", c)).otherwise(F.coalesce(c, f"_{c}"))
    return out.withColumns({c: pick(c) for c in columns}).drop(*[f"_{c}" for c in columns])


def match_rates(left: DataFrame, right: DataFrame, strategies: Mapping[str, Column], right_key: str) -> DataFrame:
    """For each key transform: share of left rows with a partner. One job: stacked keys, distinct right keys."""
    tried = left.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("string").alias("k")) for n, c in strategies.items()])).alias("x")).select("x.*")
    keys = right.select(F.col(right_key).cast("string").alias("k"), F.lit(1).alias("hit")).distinct()
    return tried.join(keys, "k", "left").groupBy("strategy").agg((F.count("hit") / F.count("*")).alias("rate"))


def best_of_joins(left: DataFrame, right: DataFrame, strategies: Mapping[str, Column], right_key: str, least: float = 0.4) -> DataFrame:
    """Left join by the transform of greatest match rate (ties: first named); ValueError below `least`."""
    rates = {r["strategy"]: r["rate"] for r in match_rates(left, right, strategies, right_key).collect()}  # one row for each strategy
    name = max(strategies, key=lambda s: rates.get(s, 0.0))
    if rates.get(name, 0.0) < least:
        raise ValueError(f"best match rate {rates.get(name, 0.0):.2f} is below {least}")
    return left.withColumn("_k", strategies[name].cast("string")).join(right.withColumn("_k", F.col(right_key).cast("string")), "_k", "left").drop("_k").withColumn("strategy", F.lit(name))


def dedupe_join(joined: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return joined.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def fuzzy_block_match(left: DataFrame, right: DataFrame, block: str, threshold: float, second_below: bool = False) -> DataFrame:
    """left, right: block, name. Best partner by similarity inside the block, if at least `threshold` (ties: by name).

    second_below: only if no other partner reaches the threshold. Pairs come from an index of name pieces (see `name_pieces`).
    """
    pairs = name_pieces.edit_join(left, right, block, threshold)
    best = pairs.groupBy(block, "left_name").agg(F.min(F.struct((-F.col("score")).alias("neg"), "right_name"))["right_name"].alias("right_name"), F.max("score").alias("score"), F.count("*").alias("hits"))
    return (best.where("hits = 1") if second_below else best).drop("hits")


def similar_names(left: DataFrame, right: DataFrame, block: str, prefix: int = 5, least: int = 5) -> DataFrame:
    """Pairs of names of a block that are equal, contain each other (from `least` letters) or share a prefix.

    Equal names, prefixes and the first `least` letters of the contained name are keys of equi-joins, so only pairs that share one meet.
    """
    l, r = left.select(block, F.col("name").alias("a")).distinct(), right.select(block, F.col("name").alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    start = lambda df, c, n: df.where(F.char_length(c) >= n).withColumn("_k", F.substring(c, 1, n))
    places = lambda df, c: df.where(F.char_length(c) >= least).withColumn("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least))))))
    found = [
        l.join(r.withColumn("a", b), [block, "a"]),
        start(l, a, prefix).join(start(r, b, prefix), [block, "_k"]),
        start(l, a, least).join(places(r, b), [block, "_k"]).where(F.contains(b, a)),
        places(l, a).join(start(r, b, least), [block, "_k"]).where(F.contains(a, b)),
    ]
    return reduce(DataFrame.unionByName, [x.select(block, "a", "b") for x in found]).distinct()


#: Layers of `layered_match`: method and confidence.
LAYERS = {1: ("number", 1.0), 2: ("exact", 0.98), 3: ("contained", 0.9), 4: ("prefix", 0.85), 5: ("fuzzy", 0.8)}


def layered_match(left: DataFrame, right: DataFrame, block: str, fuzzy: float | None = None) -> DataFrame:
    """left, right: block, number, name. Per left row: by number, equal name, unique contained name, unique prefix, the only name
    of at least `fuzzy` similarity (where given), else none.

    Adds right_name, method, confidence and reason (of a failure). Each layer but the last is an equi-join: on the number, the
    name, the runs of whole words and the beginnings of the right names; the last sees only rows that no layer settled.
    """
    l = left.select(block, F.col("number").alias("ln"), F.col("name").alias("left_name")).distinct()
    r = right.select(block, F.col("number").alias("rn"), F.col("name").alias("right_name")).distinct()
    a, b = F.upper("left_name"), F.upper("right_name")
    key, names = [block, "ln", "left_name"], r.select(block, "right_name").distinct()
    to = lambda n: F.sequence(F.lit(1), n)
    runs = lambda w: F.flatten(F.transform(to(F.size(w)), lambda i: F.transform(to(F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), " "))))
    keyed = l.withColumn("_k", a)
    inside = names.withColumn("_k", F.explode(F.array_distinct(runs(F.split(b, " ", -1)))))
    starts = names.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(0), F.char_length(b)), lambda n: F.substr(b, F.lit(1), n))))
    found = [l.join(r.withColumn("ln", F.col("rn")), [block, "ln"]), keyed.join(names.withColumn("_k", b), [block, "_k"]), keyed.join(inside, [block, "_k"]), keyed.join(starts, [block, "_k"])]
    pairs = reduce(DataFrame.unionByName, [x.select(*key, "right_name", F.lit(k).alias("layer")) for k, x in enumerate(found, 1)])
    counted = pairs.groupBy(*key, "right_name").agg(F.min("layer").alias("layer")).groupBy(*key, "layer").agg(F.count("*").alias("n"), F.min("right_name").alias("right_name"))
    usable = counted.groupBy(*key).agg(F.min(F.when((F.col("layer") <= 2) | (F.col("n") == 1), F.struct("layer", "right_name"))).alias("x"), F.max("n").alias("most"))
    out = l.join(usable, key, "left")
    if fuzzy is not None:
        open_rows = out.where("x is null").select(block, F.col("left_name").alias("name"))
        near = fuzzy_block_match(open_rows, right, block, fuzzy, second_below=True).select(block, "left_name", F.struct(F.lit(5).alias("layer"), "right_name").alias("_near"))
        out = out.join(near, [block, "left_name"], "left").withColumn("x", F.coalesce("x", "_near"))
    of = lambda i: F.create_map(*[F.lit(v) for k, both in LAYERS.items() for v in (k, both[i])])
    failed = F.when(F.col("x").isNull(), F.when(F.col("most") > 1, "ambiguous").otherwise("no candidate"))
    return out.select(block, F.col("ln").alias("number"), F.col("left_name").alias("name"), F.col("x.right_name").alias("right_name"), F.try_element_at(of(0), F.col("x.layer")).alias("method"), F.try_element_at(of(1), F.col("x.layer")).alias("confidence"), failed.alias("reason"))


def rank_join(codes: DataFrame, items: DataFrame, region: str, code: str, order: str) -> DataFrame:
    """The n-th code of a region with its n-th item by `order`."""
    c = codes.withColumn("_n", F.row_number().over(Window.partitionBy(region).orderBy(code)))
    i = items.withColumn("_n", F.row_number().over(Window.partitionBy(region).orderBy(order)))
    return c.join(i, [region, "_n"]).withColumnRenamed("_n", "place")


def expand_keys(df: DataFrame, column: str, source: str, target: str, key: Sequence[str]) -> DataFrame:
    """Rows of `source` repeated under `target`; an own row of the target goes first."""
    copies = df.where(F.col(column) == source).withColumn(column, F.lit(target)).withColumn("_copy", F.lit(1))
    both = df.withColumn("_copy", F.lit(0)).unionByName(copies)
    return both.withColumn("_first", F.min("_copy").over(Window.partitionBy(*key))).where("_copy = _first").drop("_copy", "_first")


def even_split(placeholders: DataFrame, zones: DataFrame, region: str) -> DataFrame:
    """A placeholder dealt to all zones of its region, share 1/n each."""
    counted = zones.groupBy(region).agg(F.count("*").alias("_n"))
    return placeholders.join(zones, region).join(counted, region).withColumn("share", 1 / F.col("_n")).drop("_n")


def one_to_one_audit(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key (nulls are keys): rows on both sides and clean_one_to_one, pre_missing, post_missing or duplicate_conflict."""
    l = left.groupBy(*keys).agg(F.count("*").alias("pre")).withColumn("post", F.lit(0))
    r = right.groupBy(*keys).agg(F.count("*").alias("post")).withColumn("pre", F.lit(0))
    n = l.unionByName(r).groupBy(*keys).agg(F.sum("pre").alias("n_pre"), F.sum("post").alias("n_post"))
    kind = F.when((F.col("n_pre") > 1) | (F.col("n_post") > 1), "duplicate_conflict").when(F.col("n_pre") == 0, "pre_missing").when(F.col("n_post") == 0, "post_missing").otherwise("clean_one_to_one")
    return n.withColumn("status", kind)


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Join of the clean keys only: value_pre, value_post, shift."""
    sides = left.select(*keys, F.col(value).alias(f"{value}_pre"), F.lit(None).cast("double").alias(f"{value}_post"), F.lit(1).alias("pre"), F.lit(0).alias("post"))
    sides = sides.unionByName(right.select(*keys, F.lit(None).cast("double").alias(f"{value}_pre"), F.col(value).alias(f"{value}_post"), F.lit(0).alias("pre"), F.lit(1).alias("post")))
    both = sides.groupBy(*keys).agg(F.sum("pre").alias("pre"), F.sum("post").alias("post"), F.max(f"{value}_pre").alias(f"{value}_pre"), F.max(f"{value}_post").alias(f"{value}_post"))
    clean = both.where("pre = 1 and post = 1").drop("pre", "post")
    return clean.withColumn("shift", F.col(f"{value}_post") - F.col(f"{value}_pre"))


def outer_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, dead: float = 0.5) -> DataFrame:
    """Full outer comparison: origin, shift, absolute shift, direction (flat within `dead`). Null keys match null keys."""
    l = left.select(*keys, F.col(value).alias("pre"), F.lit(True).alias("in_l"), F.lit(None).cast("double").alias("post"), F.lit(None).cast("boolean").alias("in_r"))
    r = right.select(*keys, F.lit(None).cast("double").alias("pre"), F.lit(None).cast("boolean").alias("in_l"), F.col(value).alias("post"), F.lit(True).alias("in_r"))
    both = l.unionByName(r).groupBy(*keys).agg(F.max("pre").alias("pre"), F.max("post").alias("post"), F.max("in_l").alias("in_l"), F.max("in_r").alias("in_r"))
    shift = F.col("post") - F.col("pre")
    origin = F.when(F.col("in_l") & F.col("in_r"), "both").when(F.col("in_l"), "left_only").otherwise("right_only")
    return both.select(*keys, "pre", "post", origin.alias("origin"), shift.alias("shift"), F.abs(shift).alias("abs_shift"), F.when(shift > dead, "up").when(shift < -dead, "down").when(shift.isNotNull(), "flat").alias("direction"))


def membership_flags(universe: DataFrame, sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """For each key of any table: is it in each source, and in the universe."""
    tagged = [t.select(F.col(key), *[F.lit(n == name).alias(f"in_{n}") for n in ("universe", *sources)]) for name, t in {"universe": universe, **sources}.items()]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(key).agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in ("universe", *sources)])


def exclusion_table(rows: DataFrame, universe: DataFrame, key: str, reason: Column) -> DataFrame:
    return rows.join(universe.select(key), key, "left_anti").withColumn("reason", reason)


# sets, top lists and reshaping


def stack_periods(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys with where they are: matched, left_only, right_only."""
    tagged = left.select(key, F.lit(1).alias("s")).unionByName(right.select(key, F.lit(2).alias("s")))
    return tagged.groupBy(key).agg(F.bit_or("s").alias("s")).select(key, F.get(F.array(F.lit("left_only"), F.lit("right_only"), F.lit("matched")), F.col("s") - 1).alias("place"))


def cross_dim(options: DataFrame, periods: Sequence[int], groups: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    """Every option in every period with its group (groups: option, period, group) or `unknown`."""
    pairs = options.select("option", F.explode(F.array(*map(F.lit, periods))).alias("period"))
    return pairs.join(groups, ["option", "period"], "left").withColumn("group", F.coalesce("group", F.lit(unknown)))


def pivot_by_level(df: DataFrame, index: Sequence[str], level: str, levels: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*index).pivot(level, list(levels)).agg(F.sum(value))


def shares_to_map(ranked: DataFrame, keys: Sequence[str], top: int = 5) -> DataFrame:
    """Per contest: map option -> share (2 digits) and the list of the `top` options by rank."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "option", F.bround("vote_share", 2).alias("share"))))
    rows = ranked.groupBy(*keys).agg(entries.alias("e"))
    return rows.select(*keys, F.map_from_entries(F.transform("e", lambda x: F.struct(x["option"], x["share"]))).alias("shares"), F.slice(F.transform("e", lambda x: x["option"]), 1, top).alias("top"))


def nested_document(spine: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One record for each row of the spine with one struct for each part (name -> (table with the key, columns))."""
    for name, (other, columns) in parts.items():
        spine = spine.join(other.select(key, F.struct(*columns).alias(name)), key, "left")
    return spine


def sectioned_top(df: DataFrame, sections: Sequence[tuple[str, str, bool]], n: int = 25, key: str = "contest") -> DataFrame:
    """(section, measure, descending): the n first rows of each, nulls out, with rank; stacked."""
    parts = []
    for name, measure, down in sections:
        rows = df.where(F.col(measure).isNotNull()).orderBy(F.desc(measure) if down else F.asc(measure), key).limit(n)
        order = Window.orderBy(F.desc("value") if down else F.asc("value"), key)  # n rows
        parts.append(rows.select(F.lit(name).alias("section"), key, F.col(measure).alias("value")).withColumn("rank", F.row_number().over(order)))
    return reduce(DataFrame.unionByName, parts)


def movements(df: DataFrame, k: int = 10) -> DataFrame:
    """Per region: k largest gains (> 0), k largest losses (< 0), by swing; ties by contest and option."""
    gain = Window.partitionBy("region").orderBy(F.desc("swing"), "contest", "option")
    loss = Window.partitionBy("region").orderBy("swing", "contest", "option")
    up = df.where("swing > 0").withColumn("rank", F.row_number().over(gain)).where(F.col("rank") <= k).withColumn("list", F.lit("gain"))
    down = df.where("swing < 0").withColumn("rank", F.row_number().over(loss)).where(F.col("rank") <= k).withColumn("list", F.lit("loss"))
    return up.unionByName(down)


def movement_lists(df: DataFrame, k: int = 10) -> DataFrame:
    """df: region, contest, margin, flipped. Per region: the k closest contests, and the k closest flipped ones; ties by contest."""
    order = Window.partitionBy("region").orderBy("margin", "contest")
    lists = [df.where("margin is not null").withColumn("list", F.lit("closest")), df.where("flipped and margin is not null").withColumn("list", F.lit("flipped"))]
    return reduce(DataFrame.unionByName, [x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) for x in lists])


def running_moments(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature (without nulls; 0.0 where there are no rows), added up row by row in the
    order of the rows as SQL engines do, so that both have the same last digits where one task reads what one thread of theirs reads.
    Each partition is folded into one state (count, sums, means, squares); states are merged in the order of partitions."""
    names = list(features)
    flat = rows.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(names)])

    def fold(batches):
        import pyarrow as pa

        n, states = 0, [(0.0, 0.0, 0.0)] * len(names)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                total, mean, squares = states[i]
                for k, x in enumerate(column.to_pylist(), n + 1):
                    total += x
                    last, mean = mean, mean + (x - mean) / k
                    squares += (x - mean) * (x - last)
                states[i] = total, mean, squares
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([list(t)]) for t in zip(*states)]], ["n", "total", "mean", "squares"])

    folded = flat.mapInArrow(fold, "n long, total array<double>, mean array<double>, squares array<double>")
    parts = folded.withColumn("part", F.spark_partition_id()).collect()  # one row for each partition
    found = {}
    for i, f in enumerate(names):
        n, total, mean, squares = 0, 0.0, 0.0, 0.0
        for p in sorted(parts, key=lambda p: p["part"]):
            m, both = p["n"], n + p["n"]
            far = p["mean"][i] - mean
            squares = p["squares"][i] + squares + far * far * m * n / both if n else p["squares"][i]
            mean = (m * p["mean"][i] + n * mean) / both if n else p["mean"][i]
            n, total = both, total + p["total"][i]
        found[f] = (total / n, math.sqrt(squares / n)) if n else (0.0, 0.0)
    return found


def nearest_neighbours(queries: DataFrame, rows: DataFrame, key: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """For each query row its k nearest other rows by Euclidean distance of z-scores (of `rows`, population sd; a constant
    feature counts 0); nulls dropped; ties by key. Exact (see `spatial`). Distances that are equal but for rounding come in the order
    of their last digits, hence the means as of `running_moments`."""
    rows, queries = rows.dropna(subset=[key, *features]), queries.dropna(subset=[key, *features])
    stats = running_moments(rows, features)
    point = F.array(*[(F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1] or 1.0) for f in features])
    found = spatial.nearest(queries.select(F.col(key).alias("a"), point.alias("point")), rows.select(F.col(key).alias("b"), point.alias("point")), [], len(features), k, spatial.euclidean, others=True)
    return found.select("a", "b", "distance", "rank")
