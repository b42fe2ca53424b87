"""URL filters: ordered host/path rules, then exact list membership by a Bloom filter cascade.

The list is a table of hosts and of labels (what `.` and `-` cut a host into); a host is listed if it or one of its labels is on
it, which one join over the distinct hosts tells. A cascade alternates Bloom filters over this complete key universe (the distinct
hosts of the corpus): level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until nothing passes wrongly. A key is listed if the first level that rejects it is an even
one. Over the universe this is exact, and pages are judged without a join: the filters are scalar subqueries of checked size.

The universe is dealt by hash into shards with a cascade each, so that no filter is longer than SHARD_BITS. All filters together
are broadcast, so they have a bound, MOST_BITS (some 10 million listed hosts); beyond it pages are joined to the universe by host.

Nulls and odd input: a null url, or one without `://`, has empty host and path, fits no rule and is not listed; null and empty
keys of the list mean nothing, repeated ones count once. Repeated pages are each judged. An empty table gives an empty result,
an empty list lists nothing. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, stored

#: (host, path, verdict).
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The default list.
LISTED_WORDS = ("ads", "adult", "bet", "bets", "casino", "pharma", "phish", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: The longest filter, and all filters of all shards together.
SHARD_BITS, MOST_BITS = 1 << 24, 1 << 28


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; host with A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; equally long ones in order of their text; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):  # the last one wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits)) for j in range(hashes)]


def _filter(keys: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
    """One row: the filter's words of 64 bits, in order."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, hashes, bits))).alias("p"))
    words = at.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    summed = words.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return summed.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def _holds(key: Column, words: Column, level: int, hashes: int, bits: int) -> Column:
    tests = []
    for p in _positions(key, level, hashes, bits):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
        tests.append(words[F.shiftright(p, 6).cast("int")].bitwiseAND(bit) != 0)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Cascade:
    """Levels of (words as a one-row DataFrame, hashes, bits)."""

    def __init__(self, levels: list[tuple[DataFrame, int, int]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Is a key of the universe listed? Exact; no join."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            words, hashes, bits = self.levels[i]
            out = F.when(_holds(key, words.scalar(), i, hashes, bits), out).otherwise(F.lit(i % 2 == 1))
        return out


def _shape(inside: int, outside: int, level: int) -> tuple[int, int]:
    """(hashes, bits) of a level."""
    rate = 0.5 if level else min(0.5, max(1e-6, math.sqrt(inside / max(1, outside) / 2)))
    hashes = max(1, round(-math.log2(rate)))
    return hashes, 64 * max(1, math.ceil(inside * hashes / math.log(2) / 64))


def build_cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """universe: key (distinct, not null), listed (boolean). Raises ValueError if the filters would exceed `most_bits`.

    The driver holds a few counts and, through the scalar subqueries, filters of at most `most_bits` bits.
    """
    n = universe.agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).first()
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    sizes, levels, spent = [n["a"], n["b"]], [], 0
    while sizes[0]:
        level = len(levels)
        hashes, bits = _shape(*sizes, level)
        spent += bits
        if spent > most_bits:
            raise ValueError(f"the cascade needs over {most_bits} bits")
        words = stored(_filter(inside, level, hashes, bits), "cascade")
        levels.append((words, hashes, bits))
        passing = outside.where(_holds(F.col("key"), words.scalar(), level, hashes, bits))
        passing = stored(passing, "cascade-keys")
        inside, outside, sizes = passing, inside, [passing.count(), sizes[0]]
    return Cascade(levels)


class Shards:
    """A cascade for each shard of the universe."""

    def __init__(self, cascades: list[Cascade]):
        self.cascades = cascades

    def contains(self, key: Column) -> Column:
        """Is a key of the universe listed? Exact; no join."""
        out = self.cascades[0].contains(key)
        for i, cascade in enumerate(self.cascades[1:], 1):
            out = F.when(_shard(key, len(self.cascades)) == i, cascade.contains(key)).otherwise(out)
        return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


def build_shards(universe: DataFrame, shard_bits: int = SHARD_BITS, most_bits: int = MOST_BITS) -> Shards:
    """universe: key (distinct, not null), listed (stored). As many shards as keep each first filter to about `shard_bits`."""
    n = universe.agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).first()
    shards = max(1, math.ceil(_shape(n["a"], n["b"], 0)[1] / shard_bits)) if n["a"] else 1
    if shards > max(1, most_bits // shard_bits):
        raise ValueError(f"the filters need over {most_bits} bits")
    if shards == 1:
        return Shards([build_cascade(universe, most_bits)])
    dealt = stored(universe.withColumn("shard", _shard(F.col("key"), shards)), "shards", "shard")
    return Shards([build_cascade(dealt.where(F.col("shard") == i).drop("shard"), most_bits) for i in range(shards)])


def keys_of(host: Column) -> Column:
    """The host and its labels, cut at `.` and `-`, without empty ones."""
    return F.array_distinct(F.filter(F.concat(F.array(host), F.split(host, "[.-]", -1)), lambda k: k != ""))


def word_list(spark: SparkSession, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """A list as a table: key."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("key"))


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", shard_bits: int = SHARD_BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """Every page: id, host, path, rule (null if none fits), verdict (the rule's, else block if it is listed), listed.

    listed: a table with the column key (hosts or labels); default: the words of LISTED_WORDS.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hosts = stored(parts.select("host").distinct(), "hosts")
    names = (word_list(pages.sparkSession) if listed is None else listed).select(F.col("key").cast("string").alias("key")).distinct()
    hit = hosts.select("host", F.explode(keys_of(F.col("host"))).alias("key")).join(names, "key").select("host").distinct()
    universe = hosts.join(hit.withColumn("found", F.lit(True)), "host", "left")
    universe = stored(universe.select(F.col("host").alias("key"), F.coalesce("found", F.lit(False)).alias("listed")), "universe")
    try:
        judged = parts.withColumn("listed", build_shards(universe, shard_bits, most_bits).contains(F.col("host")))
    except ValueError:
        judged = parts.join(universe.withColumnRenamed("key", "host"), "host")
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), "listed")
