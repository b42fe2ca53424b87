"""Similar names by an index of pieces, without comparing all names of a block.

Names a and b are similar if 1 less their edit distance over the longer length reaches a threshold, so the longer one of n letters
permits k = floor((1 - threshold) * n) edits. Cut into k + 1 pieces, at least one of its pieces stands unchanged in the shorter
name, moved by few places. So each name is indexed by its pieces, and looked up by its substrings for every length that a longer
similar name can have. Pairs that share a piece are compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _edits(length: Column, threshold: float) -> Column:
    """Edits that a pair may have whose longer name has `length` letters; rounding errs to more."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _piece(length: Column, i: Column, threshold: float) -> tuple[Column, Column]:
    """(letters before, letters of) the i-th piece of a name of `length`; the later pieces are the longer by one."""
    pieces = _edits(length, threshold) + 1
    short = F.floor(length / pieces).cast("int")
    longer_from = pieces - (length - short * pieces)
    return i * short + F.greatest(F.lit(0), i - longer_from), short + F.when(i >= longer_from, 1).otherwise(0)


def pieces(name: Column, threshold: float) -> Column:
    """Array of keys of a name as the longer one of a pair."""
    n = F.char_length(name)

    def key(i: Column) -> Column:
        start, size = _piece(n, i, threshold)
        return F.xxhash64(n, i, F.substr(name, start + 1, size))

    return F.transform(F.sequence(F.lit(0), _edits(n, threshold)), key)


def lookups(name: Column, threshold: float, longer: bool) -> Column:
    """Array of keys under which similar names of no fewer letters (longer: of more) are found."""
    n = F.char_length(name)
    most = F.floor(n / threshold + 1e-9).cast("int")
    none = F.array().cast("array<bigint>")

    def of_piece(length: Column, i: Column) -> Column:
        start, size = _piece(length, i, threshold)
        edits, gap = _edits(length, threshold), n - length
        # a piece moved by d leaves |d| edits before it and |gap - d| behind it
        low = F.greatest(F.ceil((gap - edits) / 2).cast("int"), -start)
        high = F.least(F.floor((gap + edits) / 2).cast("int"), n - size - start)
        keys = F.transform(F.sequence(low, high), lambda d: F.xxhash64(length, i, F.substr(name, start + d + 1, size)))
        return F.when(low <= high, keys).otherwise(none)

    def of_length(length: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), _edits(length, threshold)), lambda i: of_piece(length, i)))

    first = n + 1 if longer else n
    return F.when(first <= most, F.array_distinct(F.flatten(F.transform(F.sequence(first, most), of_length)))).otherwise(none)


def edit_join(left: DataFrame, right: DataFrame, block: str, threshold: float) -> DataFrame:
    """left, right: block, name. All pairs of distinct names of a block with a similarity of at least `threshold` (over 0): block,
    left_name, right_name, score. Null names and blocks have no partner; two empty names are equal.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    l = left.select(block, F.col("name").alias("left_name")).where("left_name is not null").distinct()
    r = right.select(block, F.col("name").alias("right_name")).where("right_name is not null").distinct()
    index = lambda df, c: df.withColumn("_k", F.explode(pieces(F.col(c), threshold)))
    look = lambda df, c, longer: df.withColumn("_k", F.explode(lookups(F.col(c), threshold, longer)))
    pairs = look(l, "left_name", False).join(index(r, "right_name"), [block, "_k"]).unionByName(look(r, "right_name", True).join(index(l, "left_name"), [block, "_k"]))
    scored = pairs.select(block, "left_name", "right_name", similarity(F.col("left_name"), F.col("right_name")).alias("score"))
    return scored.where(F.col("score") >= threshold).distinct()
