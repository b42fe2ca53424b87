"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules reject a document by fixed limits. For the others, labelled holdout documents choose the cutoffs, in two halves
dealt by a hash of the id:

1. In the first half, each stratum takes for each rule the cutoff of a grid that rejects most bad documents less good ones (ties:
   fewest good ones, then the higher cutoff), of those that falsely reject at most `risk` there. Its rules are put in order of
   that gain: a chain of verdicts, each with one more rule.
2. In the second half every verdict of every stratum's chain is a hypothesis "base and learnt rules together falsely reject more
   than `risk` of the good documents". It is refuted if the exact binomial P(Binomial(n, risk) <= k) <= delta / tests, where k
   of the stratum's n good documents go, and `tests` is the number of all hypotheses (Bonferroni over strata and chains).
   Of a stratum's refuted ones the verdict with the highest gain applies (ties: fewest rules).

A stratum without enough labels, or whose base rules alone take more than `risk`, keeps what the base rules keep. With
probability 1 - delta no stratum in which a learnt rule applies loses more than `risk` of its good documents by the whole verdict.

Nulls and odd input: a null text has no words and fails the base; a null stratum is a stratum; a row with a null id has no
label; of several labels for an id the least counts; other columns are kept out; an empty table gives an empty result, and no
labels no learnt cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Up to this many labels (9 bytes each) are broadcast to their documents; beyond it both sides are shuffled.
RISK, DELTA, MOST_BROADCAST, SEED = 0.05, 0.05, 2_000_000, 23
#: Cutoffs tried for each rule; a document goes if its measure is above the cutoff.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.4),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.02, 0.05, 0.1, 0.15),
    "same_word_share": (0.1, 0.2, 0.3, 0.5),
    "bang_share": (0.05, 0.1, 0.2, 0.4),
}


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures of GRID."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.withColumn("_t", text)
    one = one.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    one = one.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_w").cast("long"))
    one = one.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    without = lambda pattern: F.char_length("_t") - F.char_length(F.regexp_replace("_t", pattern, ""))
    one = one.withColumn("n_symbols", without(r"[#*$%&|<>]+").cast("long"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = one.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    h = F.col("_h")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 5, F.lit(0))), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
    one = one.withColumn("_g", F.when(F.col("n_words") >= 5, grams))
    # only texts that repeat a window pay for its places: sort (window, place), keep those with an equal neighbour
    one = one.withColumn("_again", F.size(F.array_distinct("_g")) < F.size("_g"))
    one = one.withColumn("_s", F.when(F.col("_again"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("_s")
    placed = F.filter("_s", lambda x, i: F.get(s, i - 1)["g"].eqNullSafe(x["g"]) | F.get(s, i + 1)["g"].eqNullSafe(x["g"]))
    one = one.withColumn("_p", F.array_sort(F.transform(placed, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform("_p", lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    one = one.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    pairs = F.size(F.filter(F.transform("_h", lambda x, i: x == F.get(h, i - 1)), lambda b: b))
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    one = one.withColumns({
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": without(r"[A-Z]+") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_l"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "same_word_share": pairs / words,
        "bang_share": (F.char_length("_t") - F.char_length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))) / words,
    })
    return one.drop("_t", "_w", "_h", "_l", "_g", "_again", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """By Stirling's series; for n >= 30 it is off by less than 1e-13."""
    return n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5)))


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k): log terms by recurrence, summed relative to the largest.

    Terms over 40 standard deviations below k are nothing beside it, so the work grows with the root of n.
    """
    k, n = k.cast("long"), n.cast("long")
    step = math.log(p / (1 - p))
    low = k - 40 * F.ceil(F.sqrt(n * p)) - 30
    low = F.when(low < 30, F.lit(0)).otherwise(low).cast("long")
    x, m = low.cast("double"), n.cast("double")
    far = log_factorial(m) - log_factorial(x) - log_factorial(m - x) + x * step + m * math.log(1 - p)
    first = F.when(low == 0, m * math.log(1 - p)).otherwise(far)

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + step
        total = F.greatest(s["total"], term) + F.log1p(F.exp(-F.abs(s["total"] - term)))
        return F.struct(term.alias("term"), F.when(i > k, s["total"]).otherwise(total).alias("total"))

    logs = F.aggregate(F.sequence(low + 1, F.greatest(k, low + 1)), F.struct(first.alias("term"), first.alias("total")), add)
    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(logs["total"]))


def _keyed(table: DataFrame, value: str) -> Column:
    """stratum, rule and a value, as a scalar map: at most a row for each stratum and rule."""
    entry = F.struct(F.concat_ws("\1", "stratum", "rule").alias("k"), value)
    return table.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def _over(cutoffs: Column, found: Callable[[str], Column]) -> list[Column]:
    """For each rule, `found` of it where it rejects the row, else null."""
    return [F.when(F.col(r) > F.try_element_at(cutoffs, F.concat_ws("\1", "stratum", F.lit(r))), found(r)) for r in GRID]


def choose_cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """labelled: stratum, good (boolean), half (0: chooses, 1: tests), base_failed, the measures of GRID. Returns stratum, rule, cutoff."""
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("gone")) for r, grid in GRID.items() for c in grid]
    tries = labelled.where("half = 0 and not base_failed").select("stratum", "good", F.inline(F.array(*cells)))
    counts = tries.groupBy("stratum", "rule", "cutoff").agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("gone")).alias("k"), F.count_if(~F.col("good") & F.col("gone")).alias("caught"))
    worth = counts.where((F.col("caught") > F.col("k")) & (F.col("k") <= risk * F.col("n")))
    best = worth.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("caught") - F.col("k")).alias("gain"), (-F.col("k")).alias("few"), "cutoff")).alias("b")).select("stratum", "rule", "b.*")
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), F.desc("few"), "rule"))  # a row for each rule
    chain = stored(best.select("stratum", "rule", "cutoff", place.alias("place")), "chain")
    cutoffs, places = _keyed(chain, "cutoff"), _keyed(chain, "place")
    tested = labelled.where("half = 1").withColumn("_c", cutoffs).withColumn("_p", places)
    first = F.array_min(F.array_compact(F.array(*_over(F.col("_c"), lambda r: F.try_element_at("_p", F.concat_ws("\1", "stratum", F.lit(r)))))))
    gone = tested.groupBy("stratum", F.when(F.col("base_failed"), 0).otherwise(F.coalesce(first, F.lit(len(GRID) + 1))).alias("first")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    steps = chain.select("stratum", "place").join(gone, "stratum").groupBy("stratum", "place")  # at most a row for each rule and step
    reached = F.col("first") <= F.col("place")
    judged = steps.agg(F.sum("good").alias("n"), F.sum(F.when(reached, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(reached, F.col("bad")).otherwise(0)).alias("caught"))
    judged = stored(judged, "tests")
    tests = chain.agg(F.count("*")).scalar()
    safe = judged.where(F.col("k") <= risk * F.col("n")).where(binomial_at_most(F.col("k"), F.col("n"), risk) * tests <= delta)
    taken = safe.groupBy("stratum").agg(F.max(F.struct((F.col("caught") - F.col("k")).alias("gain"), (-F.col("place")).alias("last"))).alias("b")).select("stratum", (-F.col("b.last")).alias("last"))
    return chain.join(taken, "stratum").where(F.col("place") <= F.col("last")).select("stratum", "rule", "cutoff")


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: bool = False) -> DataFrame:
    """Every row: id, the counts, base_failed, reasons (learnt rules that reject it), kept.

    labels: id, quality (1: good). carry: adds the input row as struct `doc`. All rows are measured once, into a stored table.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0")).alias("stratum"), F.col(text_col).alias("text"), *([F.struct("*").alias("doc")] if carry else []))
    every = stored(measures(own).drop("text").withColumn("base_failed", base_failed()), "measures")
    marked = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    marked = stored(marked, "labels")
    few = marked.count() <= MOST_BROADCAST
    half = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(2)).cast("int").alias("half")
    holdout = every.join(F.broadcast(marked) if few else marked, "doc_id").select("stratum", "good", half, "base_failed", *GRID)
    cutoffs = stored(choose_cutoffs(stored(holdout, "holdout"), risk, delta), "cutoffs")
    every = every.withColumn("_c", _keyed(cutoffs, "cutoff")).withColumn("reasons", F.array_compact(F.array(*_over(F.col("_c"), F.lit))))
    return every.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), *(["doc"] if carry else []))
