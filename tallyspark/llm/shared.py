"""Helpers shared by the corpus operators: shared-folder tables, Arrow text views, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import new_path, stored  # noqa: F401

#: Word separators of the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes after which a batch for a Python worker is closed; Spark by itself closes it after 10,000 rows, however long they are.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` over batches of about BATCH_BYTES, so that the memory of executor and worker does not grow with the rows' length.

    The bound is a setting of the session, as it is read when the result is computed; one that the user has set stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fold(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; `lower` serves where all is ASCII, as it is much faster than `translate`."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_join(rows: DataFrame, side: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """`rows` (stored) joined with `side` (stored; one row for each key, with the number `n` of rows that hold it), without `n`.

    Keys of a thousandth of all rows, so at most 1,000 of them, are broadcast; the others are shuffled, none of them large.
    """
    bar = side.agg((F.coalesce(F.sum(n), F.lit(0)) / 1000).cast("long")).first()[0]
    hot = F.broadcast(side.where(F.col(n) > bar).drop(n))
    cold = rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(side.where(F.col(n) <= bar).drop(n), key)
    return rows.join(hot, key).unionByName(cold)


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, bytes of `column`) by one aggregate."""
    n, size = df.selectExpr("count(*)", f"coalesce(sum(octet_length({column})), 0)").first()
    return int(n), int(size)


def text_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying rows; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else pa.large_string()
    array = array.cast(kind)
    if array.null_count:
        array = array.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray, most: int, most_rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and `most_rows` rows each; a longer row stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, rows, at + most_rows)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_codes() -> np.ndarray:
    """A random-looking 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


CODES, BASE = byte_codes(), 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)


def span_hash(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of the stretches of `data` between `bounds`: polynomials in BASE by running sums."""
    steps = np.full(len(data) + 1, BASE, np.uint64)
    steps[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * np.cumprod(steps, out=steps)[:-1], out=sums[1:])
    back = np.full(len(data) + 1, BACK, np.uint64)
    back[0] = 1
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) * np.cumprod(back, out=back)[bounds[:-1]])
