"""Repeated-substring removal by a depth-limited most-significant-digit radix sort of all suffixes.

Suffixes are sorted only through `length` bytes; suffixes that are still equal there start repeated windows. A digit is not
one byte but a group of the window's bytes, taken in an order that the window's content fixes, so that neighbouring suffixes
share their first digits and travel as one row:

- first digit: the gram of GRAM bytes with the least hash inside the window (so all windows around one such place, a *run*
  of consecutive suffixes, share it). Grams that occur once in the corpus leave the sort here, with all their suffixes.
- second digit: all bytes that the windows of a run span. A run equal to an earlier one is settled as a whole.
- last digit: the window itself, for the suffixes of the runs that are left.

Each pass partitions by the leading bits of its digit, sorts there, and answers every sender. The corpus lies in cells, ranges of
document ids of a few MB. A cell sends each digit once, whatever its frequency, so a passage that stands in a third of all
documents costs a bucket one entry for each cell. Because cells are in document order, the least cell that holds a digit
holds its first occurrence, and nothing but fingerprints has to travel.

Digits are told apart by fingerprints, not byte by byte: runs by 160 bits (64 of the gram, 64 and 32 of all bytes by two unlike
functions), windows by 96 (64 and 32). Every decision rests on all of these bits: whether a first digit has several second digits,
whether an earlier run or window is the same, also inside a cell. Two windows that differ are taken as one, or a repeat is
missed, with a chance of about n**2 / 2**97 for n windows that are sent: 1e-4 for 4e12 of them. The bytes themselves would have to
travel about 3.6 times over for each repeated run, as neighbouring runs overlap.

Nulls and odd input: a null text counts as empty; documents shorter than `length` stay whole; documents are taken by
ascending id, equal ids by a hash of the text and then by text, a null id last; an id of many rows is spread over cells by that hash;
repeated rows are documents of their own, so the second loses its windows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_codes, mix, row_slices, text_view, total_bytes

LAST_ID = np.iinfo(np.int64).max
GRAM, CELL_BYTES, BUCKET_BYTES, SLICE_BYTES = 24, 4 << 20, 32 << 20, 1 << 19
CODES = byte_codes()
ODD = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)


def _pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    out = a * ODD[k % 8]
    out += b
    out *= ODD[(k + 3) % 8]
    out ^= out >> np.uint64(29)
    return out


def _powers(data: np.ndarray, most: int) -> list[np.ndarray]:
    """Fingerprints of the spans of 1, 2, 4, ... bytes that start at each place."""
    out = [CODES[data]]
    while 2 << (len(out) - 1) <= most:
        n = 1 << (len(out) - 1)
        out.append(_pair(out[-1][:-n], out[-1][n:], len(out)))
    return out


def _spans(powers: list[np.ndarray], size: int) -> np.ndarray:
    """Fingerprints of all spans of `size` bytes."""
    n, at, out = len(powers[0]) - size + 1, 0, None
    for k in reversed(range(size.bit_length())):
        if size >> k & 1:
            part = powers[k][at : at + n]
            out, at = part if out is None else _pair(out, part, k + 1), at + (1 << k)
    return out


def _checks(data: np.ndarray, size: int) -> np.ndarray:
    """A second fingerprint of all spans of `size` bytes, 32 bits: a polynomial in BASE, unlike the tree of _spans."""
    steps = np.full(len(data) + 1, BASE, np.uint64)
    steps[0] = 1
    back = np.full(len(data) + 1, BACK, np.uint64)
    back[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[::-1][data] * np.cumprod(steps)[:-1], out=sums[1:])
    return (mix((sums[size:] - sums[:-size]) * np.cumprod(back)[: len(data) - size + 1]) >> np.uint64(32)).astype(np.uint32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each stretch of `width`."""
    at = np.arange(len(values), dtype=np.int32)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = values[:-step], values[step:]
        left = a <= b
        at = np.where(left, at[:-step], at[step:])
        values = np.where(left, a, b)
        reach += step
    return at


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one least gram: document, first and last start, both digits' fingerprints, the second's check; all windows' and their checks."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint64, np.uint32))
    if len(data) < length:
        return empty
    gram = min(GRAM, max(1, length // 4))
    powers = _powers(data, length)
    window, grams = _spans(powers, length), _spans(powers, gram)
    at = _least(grams, length - gram + 1)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    starts = np.flatnonzero(doc[: len(window)] == doc[length - 1 :])
    if not len(starts):
        return empty
    at, own = at[starts], doc[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last, place = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    first_digit = mix(grams[place])
    span = (last - first).astype(np.uint64) * ODD[5] + (place - first).astype(np.uint64) * ODD[6]
    second_digit = mix(_pair(_pair(window[first], window[last], 2), span, 4))
    check = _checks(data, length)
    run_check = (mix(check[first].astype(np.uint64) << np.uint64(32) | check[last]) >> np.uint64(32)).astype(np.uint32)
    return own[new].astype(np.int64), first, last, first_digit, second_digit, run_check, window, check


def _cell_runs(table: pa.Table, length: int, windows: bool) -> tuple[np.ndarray, ...]:
    """Runs of a whole cell in document order; places count from the document's start; windows: of all runs, concatenated."""
    data, offsets = text_view(table.column("text"))
    parts = []
    for a, b in row_slices(offsets, SLICE_BYTES):
        base = offsets[a : b + 1]
        doc, first, last, one, two, check, *own = _runs(data[base[0] : base[-1]], base - base[0], length)
        start = (base - base[0])[doc]
        parts.append((doc + a, first - start, last - start, one, two, check, [first, last, *own] if windows else []))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint32)
    cat = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(kinds)]
    return (*cat, [p[6] for p in parts])


def _inside(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the stretches first..last, one after the other."""
    n = last - first + 1
    return np.arange(int(n.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("hash", "ascending"), ("text", "ascending")])


def _new(*keys: np.ndarray) -> np.ndarray:
    """Does a sorted entry differ from the one before?"""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each distinct key, ascending; index of the key of each entry)"""
    order = np.lexsort(keys[::-1])
    new = _new(*(k[order] for k in keys))
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


class Digits:
    """The distinct digits of a cell's runs.

    ones, twos, checks: first digits with the second digit of each (zeros: several in this cell); one_of: index of a run's.
    pairs, pair_twos, pair_checks: both digits of the runs whose first digit has several; pair_of: index of a run's, or -1.
    again: is a run the same as an earlier one of this cell?
    """

    def __init__(self, one: np.ndarray, two: np.ndarray, check: np.ndarray):
        first, index = _group(one, two, check)
        self.again = first[index] != np.arange(len(one))
        new = _new(one[first])
        gram = np.cumsum(new) - 1
        lone = np.bincount(gram, minlength=int(new.sum())) == 1 if len(first) else np.zeros(0, bool)
        self.ones, self.one_of = one[first][new], gram[index]
        self.twos, self.checks = np.where(lone, two[first][new], 0).astype(np.uint64), np.where(lone, check[first][new], 0).astype(np.uint32)
        many = first[~lone[gram]]
        pair = mix(one[many] ^ mix(two[many]))
        order = np.argsort(pair, kind="stable")
        self.pairs, self.pair_twos, self.pair_checks = pair[order], two[many][order], check[many][order]
        place = np.full(len(first), -1)
        place[np.flatnonzero(~lone[gram])[order]] = np.arange(len(many))
        self.pair_of = place[index]


def _flags(rows: pa.Table, kind: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers to `keys`, which were sent in this order, cut at the buckets' bounds."""
    out, counts = np.zeros(len(keys), bool), np.bincount(_bucket(keys, buckets), minlength=buckets)
    begin = np.concatenate(([0], np.cumsum(counts)))
    for b, blob in zip(rows.column("bucket").to_pylist(), rows.column(kind).to_pylist()):
        if blob is not None and counts[b]:
            out[begin[b] : begin[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(counts[b]))
    return out


def _blobs(keys: np.ndarray, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    bounds = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    for b in range(buckets):
        a, z = bounds[b], bounds[b + 1]
        if z > a:
            yield b, [x[a:z].tobytes() for x in (keys, *more)]


KEYS = ("one", "two", "check", "pair", "pair_two", "pair_check")
ASK = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), *((k, pa.binary()) for k in KEYS)])
ASK_LAST = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("last", pa.binary()), ("last_check", pa.binary())])
TELL = ("several", "one", "pair", "last")
TOLD = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), *((k, pa.binary()) for k in TELL)])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _joined(blobs: list[bytes | None], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in blobs), kind)


def _packed(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def _earlier(cells: list[int], keys: tuple[np.ndarray, ...], sizes: list[int]) -> np.ndarray:
    """For each cell's keys: does a lesser cell hold the key too?"""
    cell = np.repeat(np.array(cells), sizes)
    order = np.lexsort((cell, *keys[::-1]))
    late = np.zeros(len(cell), bool)
    late[order] = ~_new(*(k[order] for k in keys))
    return late


def _several(one: np.ndarray, two: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For each cell's first digits: do several second digits follow it in the corpus?"""
    order = np.lexsort((check, two, one))
    new = _new(one[order])
    group = np.cumsum(new) - 1
    distinct = np.bincount(group, _new(one[order], two[order], check[order])) > 1 if len(one) else np.zeros(0, bool)
    many = np.zeros(len(one), bool)
    many[order] = distinct[group]
    return many | ((two == 0) & (check == 0))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", cell_bytes: int | None = None) -> DataFrame:
    """Every document: id, n_bytes, spans (array of start, end: the maximal removed runs of bytes), kept (binary).

    A byte goes if a string of `length` bytes covers it that also starts earlier, in this document or a lesser one.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows, size = total_bytes(own, "text")
    cell_bytes = cell_bytes or min(128 << 20, max(CELL_BYTES, int((size * 16) ** 0.5)))
    cells, buckets = max(1, -(-size // cell_bytes)), max(1, -(-size // BUCKET_BYTES))
    shares = [i / cells for i in range(1, cells)]
    at = F.coalesce("doc_id", F.lit(LAST_ID))
    bounds = own.agg(F.percentile_approx(at, F.lit(shares), max(10_000, 2 * cells))).first()[0] if shares else []
    edges = np.array(sorted(bounds or []), np.int64)

    @F.pandas_udf("int")
    def cell_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The cell of the id; rows of an id that several cells share are spread by hash, in order."""
        ids = ids.to_numpy()
        low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        share = (hashes.to_numpy() / 2.0**64 + 0.5) * (high - low + 1)
        return pd.Series((low + np.minimum(share.astype(np.int64), high - low)).astype(np.int32))

    hashed = own.withColumn("hash", F.xxhash64("text"))
    placed = hashed.withColumn("cell", cell_of(at, F.col("hash")))

    def first_pass(table: pa.Table) -> pa.Table:
        cell, table = table.column("cell")[0].as_py(), _ordered(table)
        digits = Digits(*_cell_runs(table, length, False)[3:6])
        a = dict(_blobs(digits.ones, buckets, digits.twos, digits.checks))
        b = dict(_blobs(digits.pairs, buckets, digits.pair_twos, digits.pair_checks))
        out = [(k, cell, *a.get(k, (None,) * 3), *b.get(k, (None,) * 3)) for k in sorted(a.keys() | b.keys())]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(ASK), ASK)], schema=ASK)

    def answer_first(table: pa.Table) -> pa.Table:
        cells, blobs = table.column("cell").to_pylist(), [table.column(k).to_pylist() for k in KEYS]
        one, two, check, pair, pair_two, pair_check = (_joined(x, np.uint32 if "check" in k else np.uint64) for k, x in zip(KEYS, blobs))
        sizes, pair_sizes = ([len(x or b"") // 8 for x in blobs[k]] for k in (0, 3))
        several = _several(one, two, check)
        told = several, _earlier(cells, (one, two, check), sizes) & ((two != 0) | (check != 0))
        answers = [*(_packed(x, sizes) for x in told), _packed(_earlier(cells, (pair, pair_two, pair_check), pair_sizes), pair_sizes)]
        return pa.Table.from_arrays([table.column("bucket"), table.column("cell"), *(pa.array(x, pa.binary()) for x in answers), pa.nulls(len(cells), pa.binary())], schema=TOLD)

    def settle(table: pa.Table, told: pa.Table):
        """Runs with what the first pass told: (runs, whole: repeats an earlier run, open: goes to the last pass, its windows and their checks)."""
        doc, first, last, one, two, check, parts = _cell_runs(table, length, True)
        digits = Digits(one, two, check)
        told = told.filter(pa.compute.is_valid(told.column("several")))
        known = _flags(told, "one", digits.ones, buckets)[digits.one_of]
        lost = _flags(told, "pair", digits.pairs, buckets)
        many = digits.pair_of >= 0
        known[many] = lost[digits.pair_of[many]]
        whole = known | digits.again
        wide = _flags(told, "several", digits.ones, buckets)[digits.one_of] & ~whole
        at, out = 0, []
        for f, z, window, window_check in parts:
            pick = wide[at : at + len(f)]
            inside = _inside(f[pick], z[pick])
            out.append((window[inside], window_check[inside]))
            at += len(f)
        windows, checks = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return (doc, first, last), whole, wide, mix(windows), checks

    def last_pass(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ASK_LAST.empty_table()
        cell, table = table.column("cell")[0].as_py(), _ordered(table)
        windows, checks = settle(table, told)[3:]
        keys = _group(windows, checks)[0]
        out = [(b, cell, *x) for b, x in _blobs(windows[keys], buckets, checks[keys])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(ASK_LAST), ASK_LAST)], schema=ASK_LAST)

    def answer_last(table: pa.Table) -> pa.Table:
        n, blobs = table.num_rows, table.column("last").to_pylist()
        sizes = [len(x) // 8 for x in blobs]
        late = _earlier(table.column("cell").to_pylist(), (_joined(blobs, np.uint64), _joined(table.column("last_check").to_pylist(), np.uint32)), sizes)
        return pa.Table.from_arrays([table.column("bucket"), table.column("cell"), *[pa.nulls(n, pa.binary())] * 3, pa.array(_packed(late, sizes), pa.binary())], schema=TOLD)

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in OUT], schema=OUT)
        table = _ordered(table)
        (doc, first, last), whole, wide, windows, checks = settle(table, told)
        key_first, index = _group(windows, checks)
        late = _flags(told.filter(pa.compute.is_valid(told.column("last"))), "last", windows[key_first], buckets)[index] | (key_first[index] != np.arange(len(windows)))
        data, offsets = text_view(table.column("text"))
        cover = np.zeros(len(data) + 1, np.int32)
        base = offsets[doc]
        np.add.at(cover, (base + first)[whole], 1)
        np.add.at(cover, (base + last + length)[whole], -1)
        starts = _inside((base + first)[wide], (base + last)[wide])[late]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = gone[a:b]
            step = np.flatnonzero(np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2])])
            kept.append(data[a:b][~own].tobytes())
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, OUT.field("spans").type), pa.array(kept, pa.binary())], schema=OUT)

    by_cell = placed.groupBy("cell")
    first = by_cell.applyInArrow(first_pass, _ddl(ASK))
    told = first.groupBy("bucket").applyInArrow(answer_first, _ddl(TOLD))
    last = by_cell.cogroup(told.groupBy("cell")).applyInArrow(last_pass, _ddl(ASK_LAST))
    told_last = last.groupBy("bucket").applyInArrow(answer_last, _ddl(TOLD))
    both = told.unionByName(told_last)
    return by_cell.cogroup(both.groupBy("cell")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("doc_id", id_col)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
