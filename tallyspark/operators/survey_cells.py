"""Survey tables as cells (file, row, col, value): what their edges name, the layout of each table, long rows of every layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import parse_percent
from tallyspark.operators.surveys import match_group, match_label

#: Headers of sample sizes, marks of share columns.
SAMPLE_HEADERS = ("n", "n=", "sample", "count", "freq", "frequency", "no", "no.")
SHARE_MARKS = ("%", "percent", "share", "pct")
#: Headers of long tables, by what the column holds.
ROLES = {"group": ("group", "voter_group", "category"), "option": ("option", "party", "alliance"), "share": ("share", "vote_share", "percent")}

Groups = Mapping[str, tuple[str, str]]


OF_FILE, OF_COLUMN, OF_ROW = ("file",), ("file", "col"), ("file", "row")
LAYOUT = ("option_cols", "group_cols", "most_options", "option_rows", "group_rows", "label_col", "share_col", "group_col", "option_col", "layout")


def file_cells(cells: DataFrame, heads: DataFrame, aliases: Mapping[str, str], groups: Groups, skip: Sequence[str] = ()) -> DataFrame:
    """The cells from their file's header row on, beside all that their table's edges say. heads: file, row (of the header).

    Adds canonical (option), group_type and group of the cell's own text; head (in the header row, which is one lower where that row
    names no option and the next at least two); hits on both edges, the most options of a column, label_col, share_col, group_col,
    option_col and the layout of the file: long, groups_in_rows, options_in_rows, marginal (labels and one share column) or unknown.

    Cells are dealt by file once; everything else is a window over a file, a column or a row of it, none of which needs more than
    that. A file is one survey table and fits a task.
    """
    named = match_group(match_label(cells, "value", aliases, skip), "value", groups)
    rows = named.join(heads.select("file", F.col("row").alias("_h")), "file")
    hits = lambda at: F.count_if((F.col("row") == at) & F.col("canonical").isNotNull()).over(Window.partitionBy(*OF_FILE))
    rows = rows.withColumns({"_own": hits(F.col("_h")), "_next": hits(F.col("_h") + 1)})
    rows = rows.withColumn("_h", F.col("_h") + ((F.col("_own") == 0) & (F.col("_next") >= 2)).cast("int")).where("row >= _h").withColumn("head", F.col("row") == F.col("_h"))

    text = F.lower(F.trim("value"))
    marked = F.lit(False)
    for mark in SHARE_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    head, below, option, group = F.col("head"), ~F.col("head"), F.col("canonical").isNotNull(), F.col("group").isNotNull()
    any_of = lambda c: F.coalesce(F.bool_or(head & c).over(Window.partitionBy(*OF_COLUMN)), F.lit(False))
    count = lambda c: F.count_if(below & c).over(Window.partitionBy(*OF_COLUMN))
    rows = rows.withColumn("_share", F.round(parse_percent(F.col("value"), loose=True), 3)).withColumns({
        "option_head": any_of(option), "group_head": any_of(group), "share_head": any_of(marked), "sample": any_of(text.isin(*SAMPLE_HEADERS)), **{f"{role}_role": any_of(text.isin(*words)) for role, words in ROLES.items()},
        "options": count(option), "groups": count(group), "shares": count(F.col("_share").isNotNull()), "rows": count(F.lit(True)), "_one": F.row_number().over(Window.partitionBy(*OF_COLUMN).orderBy("row")) == 1,
    })

    # of a file, by one cell of each column
    one = lambda f, c: f(F.when(F.col("_one"), c)).over(Window.partitionBy(*OF_FILE))
    tally = lambda name: F.count_if(F.col("_one") & F.col(name)).over(Window.partitionBy(*OF_FILE))
    left = lambda name: F.coalesce(one(F.max, F.when(F.col("col") == 0, F.col(name))), F.lit(0))
    first = lambda c: one(F.min, F.when(c, F.col("col")))
    labels = ~F.col("sample") & ~F.col("share_head") & (F.col("options") >= 2)
    filled = ~F.col("sample") & (F.col("options") < 2) & (F.col("shares") >= F.greatest(F.lit(2), F.floor(F.col("rows") / 4)))
    rows = rows.withColumns({
        "option_cols": tally("option_head"), "group_cols": tally("group_head"), "most_options": one(F.max, F.col("options")), "option_rows": left("options"), "group_rows": left("groups"),
        "_label": one(F.min, F.when(labels, F.struct((-F.col("options")).alias("n"), "col"))), "share_col": F.coalesce(first(F.col("share_head")), first(filled)),
        "group_col": first(F.col("group_role")), "option_col": first(F.col("option_role")), "_long": first(F.col("share_role")),
    }).withColumn("label_col", F.col("_label.col"))
    crossed = lambda a, b, n: (F.col(a) >= n) & (F.col(b) >= n)
    long = F.col("group_col").isNotNull() & F.col("option_col").isNotNull() & F.col("_long").isNotNull()
    layout = F.when(long, "long").when(crossed("option_cols", "group_rows", 2), "groups_in_rows").when(crossed("option_rows", "group_cols", 2), "options_in_rows")
    layout = layout.when(F.col("label_col").isNotNull() & F.col("share_col").isNotNull(), "marginal").when(crossed("option_cols", "group_rows", 1), "groups_in_rows").when(crossed("option_rows", "group_cols", 1), "options_in_rows")
    rows = rows.withColumns({"layout": layout.otherwise("unknown"), "share_col": F.when(long, F.col("_long")).otherwise(F.col("share_col"))})
    return rows.select("file", "row", "col", "value", "canonical", "group_type", "group", "head", F.col("_share").alias("share"), *LAYOUT)


def table_layouts(cells: DataFrame) -> DataFrame:
    """cells: of `file_cells`. What they say of each file, once."""
    return cells.groupBy("file").agg(*[F.first(c).alias(c) for c in LAYOUT])


def row_confidence(options: Column, positive: Column, negative: Column, explicit: Column) -> Column:
    """high, medium or low: two named options and a positive context make high (medium without a group of its own, or beside a
    negative context); one option with either of them medium."""
    sure = F.when(~explicit | negative, "medium").otherwise("high")
    return F.when(negative & ~positive, "low").when((options >= 2) & positive, sure).when((options >= 1) & (positive | explicit), "medium").otherwise("low")


def extract_cells(cells: DataFrame, signals: DataFrame | None = None, whole: tuple[str, str] = ("electorate", "all voters")) -> DataFrame:
    """Distinct rows (file, layout, group_type, group, option, share, row_label, col_label, confidence) of all tables whose layout is known.

    cells: of `file_cells`; the edges of a row or column stand beside each of its cells, so nothing is joined but the signals.
    signals: file, positive, negative (numbers of context words), question (the vote question is asked); tables with two negative
    words and no question are left out; without signals no context is known. The rows of a marginal table belong to `whole`.
    """
    is_layout = lambda *names: F.col("layout").isin(*names)
    rows = cells.where("layout <> 'unknown'")
    label_at = F.when(is_layout("marginal"), F.col("label_col")).when(is_layout("long"), F.col("option_col")).otherwise(F.lit(0))
    group_at = F.when(is_layout("long"), F.col("group_col")).when(is_layout("groups_in_rows"), F.lit(0))
    here, below, head = F.when(F.col("group").isNotNull(), F.struct("group_type", "group")), ~F.col("head"), F.col("head")
    beside = lambda at, c: F.max(F.when(below & (F.col("col") == at), c)).over(Window.partitionBy(*OF_ROW))
    above = lambda c: F.max(F.when(head, c)).over(Window.partitionBy(*OF_COLUMN))
    rows = rows.withColumns({"_co": above(F.col("canonical")), "_cg": above(here), "col_label": above(F.trim("value"))})
    rows = rows.withColumns({"_ro": beside(label_at, F.col("canonical")), "_rg": beside(group_at, here), "row_label": beside(label_at, F.trim("value"))})
    body = rows.where(below & F.col("share").isNotNull() & F.when(is_layout("marginal", "long"), F.col("col") == F.col("share_col")).otherwise(F.col("col") > 0))
    option = F.when(is_layout("groups_in_rows"), F.col("_co")).otherwise(F.col("_ro"))
    group = F.when(is_layout("marginal"), F.struct(F.lit(whole[0]).alias("group_type"), F.lit(whole[1]).alias("group"))).when(is_layout("options_in_rows"), F.col("_cg")).otherwise(F.col("_rg"))
    out = body.withColumns({"option": option, "_g": group, "_n": F.greatest("option_cols", "most_options")}).where("option is not null and _g is not null")
    if signals is None:
        out = out.withColumns({"positive": F.lit(False), "negative": F.lit(False)})
    else:
        asked = F.coalesce("question", F.lit(False))
        flags = signals.select("file", (asked | (F.coalesce("positive", F.lit(0)) >= 1)).alias("positive"), (F.coalesce("negative", F.lit(0)) >= 2).alias("negative"), asked.alias("_q"))
        out = out.join(flags, "file", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("positive", "negative", "_q")}).where("not negative or _q")
    sure = row_confidence(F.col("_n"), F.col("positive"), F.col("negative"), ~is_layout("marginal"))
    return out.select("file", "layout", "_g.group_type", "_g.group", "option", "share", "row_label", "col_label", sure.alias("confidence")).distinct()


def table_potential(cells: DataFrame, kinds: DataFrame | None = None, useful: Sequence[str] = (), useless: Sequence[str] = ()) -> DataFrame:
    """Per file: distinct options and groups named, numeric and percent cells, layout and the potential of extracting it. cells: of `file_cells`.

    kinds: file, kind; kinds in `useful` add 15, in `useless` take 20. Fixed values: 4 an option and 3 a group (at most 6 each), 12 for a
    crossed or marginal layout, 0.4 a percent cell (at most 30), 0.05 a number (at most 40).
    """
    per = cells.groupBy("file").agg(
        F.first("layout").alias("layout"),
        F.count_distinct("canonical").alias("options"), F.count_distinct(F.when(F.col("group").isNotNull(), F.struct("group_type", "group"))).alias("groups"),
        F.count_if(~F.col("head") & F.trim("value").try_cast("double").isNotNull()).alias("numbers"), F.count_if(~F.col("head") & parse_percent(F.col("value")).isNotNull()).alias("percents"),
    )
    per = per.withColumn("kind", F.lit(None).cast("string")) if kinds is None else per.join(kinds.select("file", "kind"), "file", "left")
    most = lambda c, n, k: F.least(F.col(c), F.lit(n)) * F.lit(k)
    shape = F.when(F.col("layout").isin("groups_in_rows", "options_in_rows", "marginal"), 12.0).otherwise(0.0)
    bonus = F.when(F.col("kind").isin(*useful), 15.0).when(F.col("kind").isin(*useless), -20.0).otherwise(0.0)
    score = most("options", 6, 4.0) + most("groups", 6, 3.0) + shape + bonus + most("percents", 30, 0.4) + most("numbers", 40, 0.05)
    return per.withColumn("potential", F.round(F.greatest(score, F.lit(0.0)), 2))


def prioritise_tables(tables: DataFrame, file: str, text: str, keywords: Sequence[str], boosts: Sequence[str], low: Sequence[str], types: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each file once, by all its texts: score (keywords that any text holds, and boosts once more), bucket, and the first of `types`
    with a word in it.

    high: a score of 4 with at most 2 of the `low` words; medium: 2. Files of empty and null texts score 0, type unclear.
    """
    words = sorted({*keywords, *boosts, *low, *(w for some in types.values() for w in some)})
    lower = F.lower(F.coalesce(text, F.lit("")))
    once = tables.groupBy(file).agg(*[F.max(F.contains(lower, F.lit(w)).cast("int")).alias(f"_{i}") for i, w in enumerate(words)])
    count = lambda some: sum((F.col(f"_{words.index(w)}") for w in sorted(set(some))), F.lit(0))
    kind = F.lit("unclear")
    for name, some in reversed(list(types.items())):
        kind = F.when(count(some) > 0, name).otherwise(kind)
    out = once.select(file, (count(keywords) + count(boosts)).alias("score"), count(low).alias("_low"), kind.alias("suggested"))
    return out.withColumn("bucket", F.when((F.col("score") >= 4) & (F.col("_low") <= 2), "high").when(F.col("score") >= 2, "medium").otherwise("low")).drop("_low")
