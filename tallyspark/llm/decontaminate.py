"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the least hashes of its grams of GRAM words in every stretch of `window - GRAM + 1` grams, with their
places; two texts that share `window` words in a row share one of them, at one place of those words. Training
and benchmark fingerprints are joined. Each hit is extended from its place: of the stretches of `window` words that contain the
gram, those that an item holds word by word are hit. Benchmark items of fewer words are one window: for each such length, all
grams of that length in the documents are fingerprints.

Extension is a join of the stretches around hits with the items' windows, on the words themselves, so a gram that thousands of
items and documents share costs a few rows for each place and no pair of place and item.

The benchmark side is broadcast when its fingerprints or windows are few (both are counted first), else both sides are
shuffled. A document's text is not shuffled: hits are grouped by document and joined back to it.

Nulls and odd input: a null text, or one without words, has no fingerprint; items with a null id or text match nothing;
repeated documents are judged one by one, repeated items count once; other columns are ignored; empty tables give no hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, stored

GRAM, WINDOW = 8, 13
#: Sides of up to so many rows (and so many bytes of words) are broadcast.
MOST_BROADCAST, MOST_BYTES = 1_000_000, 64 << 20
#: Fixed value: what lies between words. ASCII but for digits and letters; A-Z are folded before.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before folding, for counting.
UNFOLDED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), BREAKS, -1), lambda w: w != "")


def _grams(hashes: Column, n: Column, size: int) -> Column:
    """Hashes of all grams of `size` words; empty if there are fewer words."""
    last = n - size
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _rolling(rows: DataFrame, column: str, width: int, pick: Callable[[Column, Column], Column]) -> DataFrame:
    """Replaces an array by what `pick` keeps of each `width` neighbours; each step is a column of its own, so that none is computed twice."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        size = F.greatest(F.size(column) - step, F.lit(0))
        rows = rows.withColumn(column, F.zip_with(F.slice(column, 1, size), F.slice(column, step + 1, size), lambda x, y: pick(x, y)))
        reach += step
    return rows


def winnowed(rows: DataFrame, grams: str, stretch: int) -> DataFrame:
    """Adds `at`: places of the least values of every stretch of `grams` (arrays of at least `stretch`, or empty).

    A gram is the least of some stretch around it if the greatest of their least values is its own.
    """
    rows = _rolling(rows.withColumn("at", F.col(grams)), "at", stretch, F.least)
    pad = F.array_repeat(F.lit(-(2**63)), stretch - 1)
    rows = _rolling(rows.withColumn("at", F.concat(pad, "at", pad)), "at", stretch, F.greatest)
    rows = rows.withColumn("at", F.zip_with(grams, F.slice("at", 1, F.size(grams)), lambda x, y: x == y))
    return rows.withColumn("at", F.array_compact(F.transform("at", lambda x, i: F.when(x, i))))


def fingerprints(rows: DataFrame, key: str, window: int, gram: int, lengths: list[int]) -> DataFrame:
    """key, at, m, h: the fingerprints of windows of `window` words (m: window) and of items of m words."""
    one = rows.select(key, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    one = one.withColumn("n", F.size("hs")).withColumn("g", F.when(F.col("n") >= window, _grams(F.col("hs"), F.col("n"), gram)).otherwise(F.array().cast("array<bigint>")))
    one = winnowed(one, "g", window - gram + 1)
    found = F.transform("at", lambda i: F.struct(i.alias("at"), F.lit(window).alias("m"), F.get("g", i).alias("h")))
    for m in lengths:
        found = F.concat(found, F.transform(_grams(F.col("hs"), F.col("n"), m), lambda h, i: F.struct(i.alias("at"), F.lit(m).alias("m"), h.alias("h"))))  # noqa: B023
    return one.select(key, F.inline(found))


def _small(df: DataFrame, *sizes: Column) -> DataFrame:
    """df (stored), to be broadcast if it is small; sizes: bytes of what is not of fixed size in a row."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(sizes, F.lit(64)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= MOST_BROADCAST and size <= MOST_BYTES else df


def _bytes(words: str) -> Column:
    """Bytes of an array of strings."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row: id, n_words, spans (array of from, to: hit windows), items (sorted as strings), n_hit, contaminated.

    carry: adds the input row as struct `doc`.
    """
    row = F.concat_ws(":", "doc_id", F.hex(F.xxhash64("text")))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(row.alias("row"), "text")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null").distinct()
    items = stored(items.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words")).where("n > 0"), "items")
    lengths = [r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect()]  # at most window - 1 numbers
    prints = fingerprints(items.where(F.col("n") >= window), "item", window, gram, []).select("h")
    for m in lengths:
        prints = prints.unionByName(fingerprints(items.where(F.col("n") == m), "item", window, gram, [m]).select("h"))
    prints = _small(stored(prints.distinct(), "prints"))
    hits = fingerprints(own, "row", window, gram, lengths).join(prints, "h", "left_semi")
    hits = _small(stored(hits.groupBy("row").agg(F.collect_set(F.struct("at", "m")).alias("hits")), "hits"), F.octet_length("row"), F.size("hits") * 24)

    # the stretches of an item's length around each hit, with their words
    chosen = own.join(hits, "row").dropDuplicates(["row"]).select("row", "hits", words_of(F.col("text")).alias("words"))
    lowest = lambda x: F.when(x["m"] < window, x["at"]).otherwise(F.greatest(F.lit(0), x["at"] + gram - window))
    highest = lambda x: F.when(x["m"] < window, x["at"]).otherwise(F.least(x["at"], F.size("words") - window))
    around = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(F.sequence(lowest(x), highest(x)), lambda i: F.struct(i.alias("at"), x["m"].alias("m"))))))
    around = chosen.select("row", "words", around.alias("a"))
    around = around.select("row", F.inline(F.transform("a", lambda x: F.struct(x["at"].alias("at"), (x["at"] + x["m"]).alias("end"), F.slice("words", x["at"] + 1, x["m"]).alias("own")))))
    m = F.least("n", F.lit(window))
    test = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - m), lambda i: F.slice("words", i + 1, m))).alias("own"))
    test = _small(stored(test.groupBy("own").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows"), _bytes("own"), _bytes("items"))
    by_row = around.join(test, "own").groupBy("row", "at").agg(F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    reach = F.max("end").over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    by_row = by_row.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce(reach, F.lit(0)))))
    told = by_row.groupBy("row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("from"), F.col("end").alias("to")))).alias("spans"))
    told = _small(stored(told, "told"), F.octet_length("row"), F.size("spans") * 32, _bytes("items"))
    carried = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct("*").alias("doc")] if carry else []))
    n_words = F.coalesce(F.regexp_count("text", F.lit(UNFOLDED_WORD)), F.lit(0)).cast("long")
    out = carried.select("doc_id", row.alias("row"), *(["doc"] if carry else []), n_words.alias("n_words"))
    out = out.join(told, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"), *(["doc"] if carry else []))
