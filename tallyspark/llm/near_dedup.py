"""Near-duplicate groups of documents by HyperMinHash sketches.

1. Every document becomes the set of its word shingles (64-bit hashes). A sketch has REGISTERS registers; each shingle falls
   into one by its hash, and a register keeps its least hash in short form: the count of leading zeros and MANTISSA bits
   after them. Documents with equal sets are one class, represented by the least id.
2. Bands of ROWS registers of the representatives are hashed to keys; representatives that share a key are candidates.
   With 48 bands of 8, a pair at similarity 0.85 shares none with probability 2e-7, one at 0.8 with 1.5e-4. For the keys
   alone, empty registers of short documents borrow from others in a fixed order.
3. Candidates pass by their set sizes, by 128 single bits of their registers (a bound five standard deviations off; sets of
   under 64 shingles are not held to it), and by the collision-corrected similarity estimate of their sketches (six standard
   deviations below the threshold still pass), then are confirmed on the full sets.
4. Components come from alternating large-star and small-star steps over the confirmed links.

No bucket is paired with itself. First each bucket's members meet its least member only, which links groups of copies at a
few pairs for each copy; then, in as many turns as asked for, the members of other components meet another member of the bucket. Documents of
buckets that still hold several components are then compared completely, by an exact
prefix filter on their full sets; so no link inside a bucket is lost, and thousands of documents that share a passage but stay
below the threshold are not paired at all unless they share rare shingles.

Nulls and odd input: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer words
than a shingle is one shingle; a row with a null id links nothing, has a null component and is kept; rows of one id are one
document: each of their texts is judged by itself, and what any of them is linked with is linked with the id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_codes, in_arrow, mix, row_slices, stored, text_view

REGISTERS, MANTISSA, ROWS, BANDS, EMPTY = 384, 10, 8, 48, 0xFFFF
SLICE_BYTES, SLICE_ROWS, SLOTS, BLOCKS = 1 << 19, 1000, 1 << 23, 1024
#: Fixed value of the method: unlike registers of sets of one size agree with this chance over 2**MANTISSA.
COLLISION = 0.339838974
#: Up to this many candidate ids (8 bytes each) are broadcast to pick their texts; beyond it they are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Few links are not dealt over as many files as there are shuffle partitions: every round reads them again.
LEAST_FILES, FILE_ROWS = 8, 50_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CODES = byte_codes()
SEPARATORS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers_of(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word, in order; A-Z count as a-z."""
    word = ~SEPARATORS[data]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    starts = np.flatnonzero(word & (~before | head[:-1]))
    after = np.concatenate((word[1:], [False])) if len(data) else word
    ends = np.flatnonzero(word & (~after | head[1:])) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[FOLD[data]] * _powers_of(BASE, len(data)))))
    hashes = (sums[ends] - sums[starts]) * _powers_of(INVERSE, len(data) + 1)[starts]
    return np.searchsorted(offsets, starts, "right") - 1, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, sorted by both."""
    doc, words = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    own, found = [], []
    for n in range(1, size + 1):  # shorter ones: of documents with just n words
        if n < size:
            first = begin[count == n]
        else:
            first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
        h = np.zeros(len(first), np.uint64)
        for j in range(n):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[first + j])
        own.append(doc[first])
        found.append(h + np.uint64(n if n < size else 0))
    own, found = np.concatenate(own), np.concatenate(found)
    order = np.lexsort((found, own))
    own, found = own[order], found[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1])
    return own[new], found[new]


def registers(own: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS: leading zeros of the least 52-bit hash above MANTISSA bits of what follows the first one."""
    h = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(rows * REGISTERS, 2**52, np.int64)
    np.minimum.at(least, own * REGISTERS + (h % np.uint64(REGISTERS)).astype(np.int64), (h >> np.uint64(12)).astype(np.int64))
    fraction, exponent = np.frexp(least.astype(np.float64))
    short = (52 - np.minimum(exponent, 52)) << MANTISSA | np.where(least > 0, ((fraction * 2 - 1) * (1 << MANTISSA)), 0).astype(np.int64)
    return np.where(least == 2**52, EMPTY, short).astype(np.uint16).reshape(rows, REGISTERS)


def set_marks(own: np.ndarray, hashes: np.ndarray, rows: int) -> list[np.ndarray]:
    """Two 64-bit sums over the set of each row: a fingerprint that does not depend on order."""
    sums = [np.zeros(rows, np.uint64) for _ in range(2)]
    for k, out in enumerate(sums):
        np.add.at(out, own, mix(hashes + np.uint64(0x1234567 * (k + 1))))
    return [x.view(np.int64) for x in sums]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit fingerprint of the set), bits_a, bits_b (a bit of 128 registers), sketch (binary; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in row_slices(offsets, SLICE_BYTES, SLICE_ROWS):
                cut = offsets[a : b + 1]
                own, found = shingles(data[cut[0] : cut[-1]], cut - cut[0], size)
                n = np.bincount(own, minlength=b - a)
                sums = set_marks(own, found, b - a)
                sketch = registers(own, found, b - a)
                bits = np.packbits(mix(filled(sketch)[:, :128].astype(np.uint64)) >> np.uint64(63) == 1, axis=1).view(np.int64)
                blobs = pa.array([row.tobytes() if some else None for row, some in zip(sketch, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(bits[:, 0]), pa.array(bits[:, 1]), blobs], ["doc_id", "n_shingles", "set_a", "set_b", "bits_a", "bits_b", "sketch"])

    return in_arrow(docs, run, "doc_id long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, sketch binary")


def filled(sketch: np.ndarray) -> np.ndarray:
    """Empty registers borrow from others in an order that all documents share, at last from the next one that is not empty."""
    out, places = sketch.copy(), np.arange(REGISTERS)
    for turn in range(1, 13):
        source = (mix(places.astype(np.uint64) + np.uint64(turn << 16)) % np.uint64(REGISTERS)).astype(np.int64)
        lent = sketch[:, source]
        out = np.where((out == EMPTY) & (lent != EMPTY), lent, out)
    some = np.concatenate((sketch, sketch), axis=1) != EMPTY
    ahead = np.where(some, np.arange(2 * REGISTERS), 2 * REGISTERS)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
    return np.where(out == EMPTY, np.take_along_axis(sketch, ahead, axis=1), out)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the bands, for each row of a sketch that is not all empty."""
    bands = filled(sketch)[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, j])
    return key.view(np.int64)


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(list(band_keys(sketch)), pa.list_(pa.int64()))], ["node", "keys"])

    keyed = in_arrow(classes.select("node", "sketch"), run, "node long, keys array<long>")
    return keyed.select(F.explode("keys").alias("key"), "node")


def _likely(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs whose sketches do not rule the threshold out."""
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("n_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                used = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
                same = ((x == y) & (x != EMPTY)).sum(axis=1)
                # that two unlike registers agree in their short form: less for sets of unlike sizes, whose leading zeros differ
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                chance = COLLISION / (1 << MANTISSA) * 4 * n * m / (n + m) ** 2
                guess = (same / used - chance) / (1 - chance)
                keep = guess >= share - 6 * np.sqrt(share * (1 - share) / used) - 1e-9
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    return in_arrow(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, found (the sorted 64-bit shingles as binary) of the classes of `ids` (stored, distinct nodes), from the text that stands for each."""
    few = ids.count() <= MOST_BROADCAST
    wanted = classes.join(F.broadcast(ids) if few else ids, "node").select("node", "doc_id", F.col("set_a").alias("want_a"), F.col("set_b").alias("want_b"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "want_a", "want_b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column("text"))
            want = [batch.column(c).to_numpy() for c in ("want_a", "want_b")]
            for a, b in row_slices(offsets, SLICE_BYTES, SLICE_ROWS):
                cut = offsets[a : b + 1]
                own, found = shingles(data[cut[0] : cut[-1]], cut - cut[0], size)
                parts = np.split(found, np.cumsum(np.bincount(own, minlength=b - a))[:-1])
                same = np.logical_and(*[x == y[a:b] for x, y in zip(set_marks(own, found, b - a), want)])
                part = pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([p.tobytes() for p in parts], pa.binary())], ["node", "found"])
                yield part.filter(pa.array(same))  # an id may have other texts besides

    return stored(in_arrow(chosen, run, "node long, found binary").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| of their full sets."""
    ids = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidates")
    every = _sets(ids, classes, docs, size)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((x, y)), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(inter > 0 and 100 * inter >= percent * (len(both) - inter))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    full = pairs.join(every.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(every.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return in_arrow(full, judge, "a long, b long")


def _prefix_pairs(rows: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """rows: node, n, c. All pairs of different c that can reach the threshold, by prefix filtering: in one order of all
    shingles, rare ones first, the shorter set's first n - ceil(2t / (1 + t) n) + 1 shingles and the longer one's first
    n - ceil(t n) + 1 must share one, early enough to reach the overlap. Rarity is read from a table of SLOTS counters of a byte, the only thing that reaches the driver;
    any order is right, a good one gives few pairs.
    """
    found = _sets(stored(rows.select("node"), "open"), classes, docs, size)
    share = percent / 100

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for v in batch.column("found"):
                np.add.at(total, (np.frombuffer(v.as_py(), np.uint64) >> np.uint64(41)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["slot", "n"])

    def packed(table: pa.Table) -> pa.Table:
        part = np.zeros(SLOTS // BLOCKS, np.uint8)
        part[table.column("slot").to_numpy() % len(part)] = np.minimum(table.column("n").to_numpy(), 255)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    counts = in_arrow(found, count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    blocks = counts.withColumn("block", F.floor(F.col("slot") / (SLOTS // BLOCKS)).cast("int")).groupBy("block").applyInArrow(packed, "block int, part binary")
    often = np.zeros((BLOCKS, SLOTS // BLOCKS), np.uint8)
    for row in stored(blocks, "often").collect():  # SLOTS bytes at most
        often[row["block"]] = np.frombuffer(row["part"], np.uint8)
    often = often.reshape(-1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, long = [], []
            for v in batch.column("found"):
                x = np.frombuffer(v.as_py(), np.uint64)
                x = x[np.lexsort((x, often[(x >> np.uint64(41)).astype(np.int64)]))].view(np.int64)
                short.append(x[: len(x) - int(np.ceil(2 * share / (1 + share) * len(x) - 1e-9)) + 1])
                long.append(x[: len(x) - int(np.ceil(share * len(x) - 1e-9)) + 1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, kind), pa.array(long, kind)], ["node", "short", "long"])

    heads = stored(in_arrow(found, cut, "node long, short array<long>, long array<long>").join(rows, "node"), "prefixes")
    low = heads.select(F.posexplode("short").alias("i", "h"), F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("c").alias("c_p"))
    high = heads.select(F.posexplode("long").alias("j", "h"), F.col("node").alias("q"), F.col("n").alias("n_q"), F.col("c").alias("c_q"))
    ordered = (F.col("n_p") < F.col("n_q")) | ((F.col("n_p") == F.col("n_q")) & (F.col("p") < F.col("q")))
    # of a pair's first common shingle, at i and j, at most the rest of both sets can be common
    reach = F.least(F.col("n_p") - F.col("i"), F.col("n_q") - F.col("j")) * (100 + percent) >= percent * (F.col("n_p") + F.col("n_q"))
    pairs = low.join(high, "h").where(reach & ordered & (F.col("c_p") != F.col("c_q")) & (100 * F.col("n_p") >= percent * F.col("n_q")))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component (the least node reachable), by large-star and small-star steps until nothing changes."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    was = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.distinct().coalesce(max(LEAST_FILES, was[0] // FILE_ROWS)), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (stored; node, component) after further links a, b (stored). Only links between its components are followed, not all links again."""
    if links.isEmpty():
        return label
    of = lambda node, name: label.select(F.col("node").alias(node), F.col("component").alias(name))
    edges = links.join(of("a", "c"), "a", "left").join(of("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    moved = stored(components(edges), "moved")
    least = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    known = label.join(F.broadcast(least) if moved.count() <= MOST_BROADCAST else least, "component", "left")
    known = known.select("node", F.coalesce("least", "component").alias("component"))
    return stored(known.unionByName(moved.join(label.select("node"), "node", "left_anti")), "labels")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", turns: int = 0) -> DataFrame:
    """Every row: id, n_shingles, component_id (least id reachable through links), kept (component_id is the own id)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stored(sketches(own, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = every.where("sketch is not null and doc_id is not null")
    # a class is a set; its node is a number of its own, as one id may have several sets
    alike = ["set_a", "set_b", "n_shingles"]
    classes = some.groupBy(*alike).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("bits_a").alias("bits_a"), F.first("bits_b").alias("bits_b"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select("*", "first.doc_id", F.col("first.row").alias("node")).drop("first"), "classes")
    keys = _banded(classes)
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    short = classes.select("node", F.col("n_shingles").cast("int").alias("n"), F.col("bits_a").alias("x"), F.col("bits_b").alias("y"))
    open_rows = stored(keys.join(shared, "key").join(short, "node"), "bands")
    unlike = F.bit_count(F.col("x").bitwiseXOR(F.col("x_a"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("y_a")))
    least_n, mean = F.least("n", "n_a"), 64 * (1 - percent / 100)
    near = (least_n < 64) | (unlike <= F.when(least_n < 400, int(mean + 27)).otherwise(int(mean + 20)))
    centres = open_rows.groupBy("key").agg(F.min(F.struct("node", "n", "x", "y")).alias("s"))
    centres = centres.select("key", F.col("s.node").alias("a"), F.col("s.n").alias("n_a"), F.col("s.x").alias("x_a"), F.col("s.y").alias("y_a"))
    stars = open_rows.join(centres, "key").where((F.col("a") < F.col("node")) & (100 * least_n >= percent * F.greatest("n", "n_a")) & near)
    tried = stored(_likely(stars.select("a", F.col("node").alias("b")).distinct(), classes, percent / 100), "pairs")
    links = stored(_confirmed(tried, classes, own, size, percent).unionByName(_same_id(some, classes, alike)), "links")
    label = stored(components(links), "labels")
    for turn in range(1, turns + 1):  # the buckets that hold several components, by other centres: pairs stay in proportion to rows
        rows = _split_buckets(open_rows, label)
        centres = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "x", "y", "c")).alias("s"))
        centres = centres.select("key", F.col("s.node").alias("a"), F.col("s.n").alias("n_a"), F.col("s.x").alias("x_a"), F.col("s.y").alias("y_a"), F.col("s.c").alias("c_a"))
        stars = rows.join(centres, "key").where((F.col("c") != F.col("c_a")) & (100 * least_n >= percent * F.greatest("n", "n_a")) & near)
        pairs = stored(stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "stars")
        if pairs.isEmpty():
            continue
        found = stored(_likely(pairs, classes, percent / 100), "pairs")
        label = _merged(label, stored(_confirmed(found, classes, own, size, percent), "links"))
        tried = tried.unionByName(found)
    rest = stored(_split_buckets(open_rows, label).select("node", "n", "c").distinct(), "open")
    if not rest.isEmpty():
        pairs = _prefix_pairs(rest, classes, own, size, percent).join(tried, ["a", "b"], "left_anti")
        more = _confirmed(stored(_likely(pairs, classes, percent / 100), "pairs"), classes, own, size, percent)
        label = _merged(label, stored(more, "links"))
    # a component has the least id of its classes, and a class the component of its node
    linked = classes.select(*alike, "doc_id", "node").join(label, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = classes.select(*alike, "doc_id", "node").join(linked.select("node", "component").join(least, "component"), "node", "left")
    out = every.join(named.select(*alike, F.coalesce("least", "doc_id").alias("least")), alike, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _split_buckets(open_rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their component `c`."""
    rows = open_rows.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    split = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    return rows.join(split, "key")


def _same_id(rows: DataFrame, classes: DataFrame, alike: list[str]) -> DataFrame:
    """Links a, b between the classes of ids that have several."""
    sets = rows.groupBy("doc_id").agg(F.min(F.struct(*alike)).alias("low"), F.max(F.struct(*alike)).alias("high")).where("low <> high").select("doc_id")
    several = stored(rows.select("doc_id", *alike).join(sets, "doc_id").distinct(), "several")
    nodes = several.join(classes.select(*alike, "node"), alike).select(F.col("doc_id"), "node")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return nodes.join(first, "doc_id").where("a < node").select("a", F.col("node").alias("b"))
