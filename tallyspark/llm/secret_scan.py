"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are found by fixed patterns, a wider fourth takes any token of 20 characters or more with a letter and a digit
that lies outside the base spans. Every value found is a candidate; its hash is counted over the whole corpus by distinct
owners and distinct repositories. A candidate is

- `plain` if it does not look like a credential (letters only or digits only),
- `live` if it does, and at most `most_owners` owners and `most_repos` repositories hold it,
- `example` if it does, but is copied more widely.

Base spans always stay; the method adds a span of kind `live` around the value of every live candidate, so a wide token that is
an example adds nothing, and of an assignment the value to be revoked is marked.

Places come from the pieces between matches: `split` and `regexp_extract_all` of one pattern give the gaps and the matches in
turn, and running sums of their lengths, by a window for each row and kind, give starts and ends in code points.

Counts are aggregated by (hash, owner, repository) first. Joined back, the values that hold a thousandth of all candidates (so at
most 1,000) are broadcast and the others shuffled, so a token in a third of all documents meets no single task.

Nulls and odd input: a null text is empty; a row with a null owner or repository has one of its own, as nothing says that
two such rows belong together; repeated rows are documents of their own for spans, and one repository if their id is; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hot_join, stored

#: The base patterns, in the order of the kinds, each with the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "live")
WIDE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
PIECE, SPAN = "array<struct<kind:int,i:int,gap:int,long:int,value:string>>", "array<struct<start:int,kind:int,end:int,value:string>>"
CANDIDATE = "array<struct<start:int,end:int,hash:string,owners:bigint,repos:bigint,class:string>>"


def _pieces(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """Array of (kind, number, length of the gap before, length, value or null if too short) of the leftmost non-overlapping matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), lambda x: x["m"].isNotNull())
    counts = lambda x: F.char_length(x["v"]) >= least
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("long"), F.when(counts(x), x["v"]).alias("value")))
    return F.when(text.rlike(pattern), made).otherwise(F.array()).cast(PIECE)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_spans(pieces: DataFrame) -> DataFrame:
    """pieces: row, owner, repo, pieces. One row for each span: row, owner, repo, kind (3: wide), start, end, value."""
    each = pieces.select("row", "owner", "repo", F.inline("pieces")).repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("long")).over(before), F.lit(0)) + F.col("gap")
    each = each.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.col("long")).cast("int")).where("value is not null")
    row, base = Window.partitionBy("row"), F.col("kind") < 3
    forth, back = row.orderBy("start", "kind", "end"), row.orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(forth.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ahead = F.coalesce(F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.col("end"))
    each = each.withColumn("free", (reached <= F.col("start")) & (ahead >= F.col("end")))
    return each.where(base | F.col("free")).select("row", "owner", "repo", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n (spans), owners, repos of every value."""
    held = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """Every row: id, base and added (arrays of start, kind, end, value), candidates (start and end of the value, its hash, owners, repos, class)."""
    text = F.coalesce(text_col, F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.monotonically_increasing_id().alias("row"))
    lone = F.concat(F.lit("\0"), "row")
    text = F.col("text")
    pieces = F.concat(_pieces(text, ASSIGN, 0, 2, 12), _pieces(text, ACCESS, 1, 0, 18), _pieces(text, HEX, 2, 0, 16), _pieces(text, WIDE, 3, 0, 20))
    found = stored(own.select("doc_id", "row", F.coalesce("owner", lone).alias("owner"), F.coalesce("repo", lone).alias("repo"), pieces.alias("pieces")), "pieces")
    spans = stored(find_spans(found.where(F.size("pieces") > 0)).withColumn("hash", F.sha2(F.col("value").cast("binary"), 256)), "spans")
    counts = stored(ownership(spans), "owners")
    looks = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    few = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    judged = hot_join(spans, counts, "hash").withColumn("class", F.when(~looks, "plain").when(few, "live").otherwise("example"))
    at = (F.col("end") - F.char_length("value")).alias("start")
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 3, F.struct("start", "kind", "end", "value")))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("class") == "live", F.struct(at, F.lit(3).alias("kind"), "end", "value")))).alias("added"),
        F.array_sort(F.collect_set(F.struct(at, "end", "hash", "owners", "repos", "class"))).alias("candidates"),
    )
    out = found.select("doc_id", "row").join(per_row, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), *[F.coalesce(c, F.array()).cast(t).alias(c) for c, t in (("base", SPAN), ("added", SPAN), ("candidates", CANDIDATE))])
