"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards, which are scanned in a cycle. Single words are counted from the first scan on. A longer phrase
is activated by the scan after both its subphrases (without its last and without its first word) have been counted `least` times,
whichever shard that was in, and is counted for exactly one cycle, so lengths interleave and its count is whole. Scanning ends
when a cycle has passed without a newly frequent subphrase.

Scans know the frequent subphrases by Bloom filters, one for each length, whose cells hold the scan by which they were set: a phrase's
first scan is the one after the latest cell of all phrases inside it, so a phrase is never looked for before those it holds. Pairs of frequent words are many and mostly rare, so the
first cycle also counts all pairs by the bucket of their fingerprint, and a pair is activated only when its bucket has reached
`least` too (the direct hashing of Park, Chen and Yu). Filters and buckets have a fixed size, whatever the corpus, and are broadcast. A false
positive activates a phrase needlessly or early, but still for one whole cycle, and counts are kept by the phrase itself, so the
counts are exact and every phrase of `least` occurrences has one; filters that are too small cost time, not results. Phrases that
end their cycle below `least` are forgotten.

A scan sums the phrases of each slice of texts before they are shuffled, and Spark sums them again before and after, so a phrase in
a third of all rows costs a row for each slice. Scores are exact decimals of 38 digits. Sides are joined by key with Spark's own choice
of plan; the best of a language are picked from its best in each of SALTS parts.

Nulls and odd input: a null text has no words; a null language is `und`; rows count whatever their id, repeated rows twice; texts of any
length are read whole; ties are broken by count and then by phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import mix, new_path, row_slices, span_hash, stored, text_view, total_bytes

SHARDS, PROBES, SALTS, SLICE_BYTES, NEVER = 4, 2, 64, 12 << 20, 255
#: Bytes of text to a bucket, and the least and the most buckets; a filter has a quarter as many cells.
CELL_SHARE, LEAST_CELLS, MOST_CELLS, BLOCK_CELLS, BITMAP = 64, 1 << 18, 1 << 27, 1 << 16, 1 << 15
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
COUNTED = "lang string, phrase string, length int, begin int, n long, block int, held binary"
BATCH = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("length", pa.int32()), ("begin", pa.int32()), ("n", pa.int64()), ("block", pa.int32()), ("held", pa.binary())])


def word_hash(words: list[bytes]) -> np.ndarray:
    return span_hash(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))


def longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Fingerprint of a phrase from those of its words but the last, and of the last."""
    return mix(head * np.uint64(0x9E3779B97F4A7C15) + word)


def cells_of(prints: np.ndarray, cells: int) -> np.ndarray:
    """Places of the fingerprints in the filter, PROBES rows."""
    step = mix(prints) | np.uint64(1)
    return np.stack([(prints + np.uint64(k) * step) & np.uint64(cells - 1) for k in range(PROBES)]).astype(np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, piece, row, fingerprint) of texts in a row: folded words in order, the piece each stands in and its text."""
    kind = KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inner = np.append(kind == 0, False)
    start = inner.copy()
    start[1:] &= ~inner[:-1] | first[1:]
    end = inner.copy()
    end[:-1] &= ~inner[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends + 1 - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(FOLDED[data[inner[:-1]]])])
    words = words.dictionary_encode()  # each distinct word is hashed and compared once
    prints = span_hash(*text_view(words.dictionary))[words.indices.to_numpy()]
    return words, _cut(starts, np.flatnonzero((kind == 2) | first[:-1])), _cut(starts, offsets[1:]), prints


def _cut(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the ascending `starts`, how many of the ascending `at` are not behind it."""
    return np.repeat(np.arange(len(at) + 1), np.diff(np.searchsorted(starts, at), prepend=0, append=len(starts)))


class Filters:
    """What scans know: for each length but the longest the scans that set its cells, the scans by which buckets of pairs were full."""

    def __init__(self, buckets: int, longest: int, least: int):
        self.since = {length: np.full(max(8, buckets // 4), NEVER, np.uint8) for length in range(1, longest)}
        self.full = np.full(buckets, NEVER, np.uint8)
        self.held = np.zeros(buckets, np.uint32)
        self.least = least

    def packed(self) -> bytes:
        """What scans need, in few bytes, as most cells are empty."""
        return zlib.compress(b"".join(x.tobytes() for x in (self.full, *self.since.values())), 1)

    @staticmethod
    def unpacked(data: bytes, buckets: int, longest: int) -> Filters:
        out, raw = Filters(8, 1, 0), np.frombuffer(zlib.decompress(data), np.uint8)
        out.full, rest = raw[:buckets], raw[buckets:].reshape(longest - 1, -1)
        out.since = dict(enumerate(rest, 1))
        return out

    def seen(self, length: int, prints: np.ndarray) -> np.ndarray:
        since = self.since[length]
        return since[cells_of(prints, len(since))].max(0)

    def bucket(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(64 - (len(self.full).bit_length() - 1))).astype(np.int64)

    def recent(self, cells: np.ndarray, scan: int, shards: int) -> bool:
        return bool(((cells != NEVER) & (cells.astype(np.int16) + shards >= scan)).any())

    def deepest(self, scan: int, shards: int) -> int:
        """The longest phrases that can be active in this scan."""
        fresh, found = self.recent(self.full, scan, shards), 1
        for length, cells in self.since.items():
            fresh |= self.recent(cells, scan, shards)
            if fresh and (cells != NEVER).any():
                found = length + 1
        return found


def phrases_in(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, known: Filters, buckets: np.ndarray, scan: int, shards: int, deepest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are active in this scan; in the first cycle adds all pairs to `buckets`."""
    words, piece, row, single = words_of(data, offsets)
    if not len(words):
        return
    word, spelt = words.indices.to_numpy(), words.dictionary
    names = langs.dictionary_encode()
    lang, tongue = names.indices.to_numpy().astype(np.int64)[row], names.dictionary
    active = lambda begin: (begin < scan) & (begin + shards >= scan)

    def counted(at: np.ndarray, length: int, begin: np.ndarray) -> pa.RecordBatch:
        """The phrases of `length` words at these places, told apart by their words."""
        key, most = lang[at], len(tongue)
        for k in range(length):
            most *= len(spelt)
            if most >= 1 << 63:  # the distinct keys are numbered anew before they overflow
                key = np.unique(key, return_inverse=True)[1]
                most = (int(key.max()) + 1) * len(spelt)
            key = key * len(spelt) + word[at + k]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        chosen, n = order[first], np.diff(first, append=len(key))
        parts = [spelt.take(pa.array(word[at[chosen] + k])).cast(pa.large_string()) for k in range(length)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]
        columns = [tongue.take(pa.array(lang[at[chosen]])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(chosen), length, np.int32)), pa.array(begin[chosen].astype(np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(chosen), pa.int32()), pa.nulls(len(chosen), pa.binary())], schema=BATCH)

    if scan < shards:
        yield counted(np.arange(len(word)), 1, np.full(len(word), -1))
    head = mix(single ^ word_hash([x.encode() for x in tongue.to_pylist()])[lang])
    seen, at = known.seen(1, head), np.arange(len(word))
    if scan < shards:
        pairs = np.flatnonzero(piece[:-1] == piece[1:])
        np.add.at(buckets, known.bucket(longer(head[pairs], single[pairs + 1])), buckets.dtype.type(1))  # of one type, which is much faster
    for length in range(2, deepest + 1):
        # places whose phrase of this length has two frequent subphrases
        begin = np.full(len(word), NEVER, np.uint8)
        begin[at] = seen[at]
        begin = np.maximum(begin[: -length + 1], begin[1 : len(word) - length + 2])
        at = np.flatnonzero((begin != NEVER) & (piece[: -length + 1] == piece[length - 1 :]))
        if not len(at):
            return
        head, below = _spread(longer(head[at], single[at + length - 1]), at, len(word)), begin[at]
        begin = (np.maximum(below, known.full[known.bucket(head[at])]) if length == 2 else below).astype(np.int64)
        pick = active(begin)
        if pick.any():
            yield counted(at[pick], length, begin[pick])
        if length < deepest:
            seen = _spread(np.maximum(known.seen(length, head[at]), below), at, len(word), NEVER)


def _spread(values: np.ndarray, at: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
    out = np.full(n, fill, values.dtype)
    out[at] = values
    return out


def summed_blocks(rows: DataFrame, most: int) -> list[tuple[int, np.ndarray]]:
    """Sums of the arrays (binary, one byte for a cell) of each block, at most `most`."""

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["held"].iloc[0]), np.int64)
        for x in rows["held"]:
            total += np.frombuffer(x, np.uint8)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "held": [np.minimum(total, most).astype(np.uint8).tobytes()]})

    return [(b, np.frombuffer(x, np.uint8)) for b, x in rows.groupBy("block").applyInPandas(summed, "block int, held binary").collect()]


def blocks_of(cells: np.ndarray, most: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(block, a byte for each cell) of the blocks of `size` cells that are not empty; at most `most` to a cell."""
    blocks = np.minimum(cells, most).astype(np.uint8).reshape(-1, size)
    return ((int(b), blocks[b].tobytes()) for b in np.flatnonzero(blocks.any(1)))


def set_cells(known: Filters, frequent: DataFrame, scan: int) -> bool:
    """Sets the cells of newly frequent phrases (lang, phrase); a bit for each cell comes to the driver."""
    cells = len(known.since[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = word_hash([x.encode() for x in batch.column("lang").to_pylist()])
            words = [x.encode().split(b" ") for x in batch.column("phrase").to_pylist()]
            size = np.array([len(x) for x in words], np.int64)
            single = word_hash([w for x in words for w in x])
            at = np.cumsum(size) - size
            for length in np.unique(size):
                own = np.flatnonzero(size == length)
                head = mix(single[at[own]] ^ langs[own])
                for k in range(1, length):
                    head = longer(head, single[at[own] + k])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cells_of(head, cells)) + (length - 1) * cells)], ["cell"])

    at = F.col("cell") + 1  # bitmaps count from 1
    bits = frequent.mapInArrow(mark, "cell long").groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = False
    for part, held in bits.collect():
        place = (part - 1) * BITMAP + np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))
        for length in np.unique(place // cells):
            since, own = known.since[int(length) + 1], place[place // cells == length] % cells
            own = own[since[own] == NEVER]
            since[own] = scan
            found |= len(own) > 0
    return found


def fill_buckets(known: Filters, rows: DataFrame, scan: int) -> bool:
    """Adds what a scan put into the buckets of pairs; the full ones are marked."""
    for block, held in summed_blocks(rows, known.least):
        known.held[block * len(held) : (block + 1) * len(held)] += held
    new = (known.held >= known.least) & (known.full == NEVER)
    known.full[new] = scan
    return bool(new.any())


def count_phrases(docs: DataFrame, least: int, longest: int, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text", cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, length, phrase, n of every phrase of up to `longest` words that occurs `least` times; lang, n: all words)"""
    if shards * (longest + 1) >= NEVER or least > NEVER:
        raise ValueError("a scan's number has one byte, as has what a bucket holds")
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = stored(own.withColumn("shard", F.expr(f"pmod(monotonically_increasing_id(), {shards})")), "shards", "shard")
    size = total_bytes(dealt, "text")[1]
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_SHARE).bit_length()))
    known = Filters(cells, longest, least)
    counters, words, scan, last = Counters(spark), None, 0, -1
    while scan < shards or scan <= last + shards:
        deepest, now = known.deepest(scan, shards), scan
        sent = spark.sparkContext.broadcast(known.packed())

        def count(batches: Iterator[pa.RecordBatch], sent=sent, now=now, deepest=deepest) -> Iterator[pa.RecordBatch]:
            filters = Filters.unpacked(sent.value, cells, longest)
            buckets = np.zeros(cells if now < shards else BLOCK_CELLS, np.uint32)
            for batch in batches:
                data, offsets = text_view(batch.column("text"))
                for a, b in row_slices(offsets, SLICE_BYTES):
                    yield from phrases_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.column("lang").slice(a, b - a), filters, buckets, now, shards, deepest)
            for block, held in blocks_of(buckets, least, min(len(buckets), BLOCK_CELLS)):
                yield pa.RecordBatch.from_pylist([{"block": block, "held": held}], BATCH)

        found = dealt.where(F.col("shard") == scan % shards).select("lang", "text").mapInArrow(count, COUNTED)
        if scan < shards:  # counts and buckets are read apart
            found = stored(found, "scan")
        counters.add(found.where("block is null"))
        new = scan < shards and fill_buckets(known, found.where("block is not null").select("block", "held"), scan)
        new |= set_cells(known, counters.table().where((F.col("n") >= least) & (F.col("old") < least) & (F.col("length") < longest)).select("lang", "phrase"), scan)
        last = scan if new else last
        if scan == shards - 1:
            words = stored(counters.table().where("length = 1").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        counters.kept = (F.col("n") >= least) | (F.col("begin") + shards > scan)
        sent.destroy()
        scan += 1
    frequent = stored(counters.table().where(F.col("n") >= least).select("lang", "length", "phrase", "n"), "frequent")
    counters.drop()
    return frequent, words


class Counters:
    """Running counts of phrases: a table bucketed by language and phrase, so that only what a scan adds is shuffled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.kept = spark, None, F.lit(True)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self) -> DataFrame:
        """lang, phrase, length, begin, n, old: what was counted before the last scan."""
        return self.spark.table(self.name)

    def add(self, found: DataFrame) -> None:
        new = found.groupBy("lang", "phrase").agg(F.max("length").alias("length"), F.max("begin").alias("begin"), F.sum("n").alias("n"))
        if self.name:
            known = self.table().where(self.kept).drop("old").withColumnsRenamed({c: f"{c}_" for c in ("length", "begin", "n")})
            both = known.hint("merge").join(new, ["lang", "phrase"], "full_outer")
            old = F.coalesce("n_", F.lit(0).cast("long"))
            new = both.select("lang", "phrase", F.coalesce("length", "length_").alias("length"), F.coalesce("begin", "begin_").alias("begin"), (old + F.coalesce("n", F.lit(0).cast("long"))).alias("n"), old.alias("old"))
        else:
            new = new.withColumn("old", F.lit(0).cast("long"))
        name = f"phrases_{uuid.uuid4().hex}"
        new.write.bucketBy(self.buckets, "lang", "phrase").sortBy("lang", "phrase").option("path", new_path(self.spark, "phrases")).option("compression", "zstd").saveAsTable(name)
        self.drop()
        self.name = name

    def drop(self) -> None:
        """Forget the table; the shared folder keeps its files, as it keeps all others."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def words_between(phrase: Column, first: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice(phrase, first, count), " ")


def mine_collocations(docs: DataFrame, least: int = 30, longest: int = 4, held: int = 80, top: int = 2000, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language.

    a: occurrences of the phrase, l and r: of the parts of its worst cut, n: of all words of the language; score: 2,000,000 a / (l + r),
    floored. A phrase goes if a longer one that holds it has `held` percent of its occurrences.
    """
    frequent, words = count_phrases(docs, least, longest, shards, lang_col, text_col, cells)
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    phrases = frequent.where("length > 1").withColumn("words", F.split("phrase", " "))

    big = lambda c: F.col(c).cast("decimal(38,0)")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cut = cut.select("lang", "phrase", "n", "k", words_between(F.col("words"), 1, F.col("k")).alias("left"), words_between(F.col("words"), F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    cut = cut.join(part.withColumnsRenamed({"part": "left", "times": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"part": "right", "times": "r"}), ["lang", "right"])
    cut = cut.withColumn("score", F.expr("cast((2000000 * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) as bigint)"))
    worst = cut.groupBy("lang", "phrase").agg(F.first("n").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where("length > 2").select("lang", F.col("n").alias("outer"), F.explode(_inner("words", longest)).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (big("outer") * 100 < big("a") * held))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inner(words: str, longest: int) -> Column:
    """All shorter phrases of two words or more inside an array of words."""
    pairs = [(first, count) for count in range(2, longest) for first in range(1, longest - count + 2)]
    found = [F.when((F.size(words) > count) & (F.size(words) >= first + count - 1), words_between(F.col(words), first, count)) for first, count in pairs]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
