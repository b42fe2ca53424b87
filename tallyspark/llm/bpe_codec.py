r"""Byte-level BPE by the tiktoken library with a local rank file: encoding of whole texts, raw-byte decoding.

Texts of up to SEGMENT characters go to the library whole. Longer ones are cut first by a regular expression, at the last safe
boundary of each segment: before a white-space character that follows anything but white space. In patterns like the public byte-level
one, where a match is white space alone or one blank and then no white space, every such place ends a match, no match
looks behind it, and a look-ahead past it never matters, so the ids of a text are those of its segments put together. A
stretch without a boundary is one segment, however long; a run of white space that leads it is a match of its own but for its last
character.

Decoding joins the raw bytes of the ids, which need not form characters one by one.

Nulls and odd input: a null or empty text has no ids and decodes to no bytes; special tokens' strings are ordinary text; rows with a
null or repeated id are rows of their own, in no order; very long texts are encoded whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import row_slices, text_view

if TYPE_CHECKING:
    import tiktoken

SEGMENT, SLICE_BYTES = 64 << 10, 4 << 20
#: The characters of the Unicode property White_Space.
BLANKS = "\t-\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
RUN, BOUNDARY = re.compile(f"[{BLANKS}]*"), re.compile(f"(?<=[^{BLANKS}])[{BLANKS}]")


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """`text` cut at safe boundaries into segments of at most `most` characters; a stretch without a boundary stays one segment."""
    at = safe = 0
    if len(text) > most:
        for match in BOUNDARY.finditer(text):
            if match.start() - at > most and safe > at:
                yield text[at:safe]
                at = safe
            safe = match.start()
        if len(text) - at > most and safe > at:
            yield text[at:safe]
            at = safe
    yield text[at:]


def coding_of(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The worker's encoding; it is made once, as workers serve many tasks."""
    memory = sys.modules.setdefault("tallyspark_worker", types.ModuleType("tallyspark_worker")).__dict__
    key = f"bpe:{rank_path}:{pattern}"
    if key not in memory:
        import tiktoken

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
        memory[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return memory[key]


def text_ids(coding: tiktoken.Encoding, text: str, most: int = SEGMENT) -> np.ndarray:
    ids = []
    for part in segments(text, most):
        run = RUN.match(part).end() if len(part) > most else 0
        if run > 1:  # one match up to its last character, or to the text's end; the library's pattern matcher runs out of stack on it
            run -= run < len(part)
            ids.append(coding._encode_single_piece(part[:run]))
            part = part[run:]
        ids.append(coding.encode_ordinary(part))
    return np.concatenate([np.array(x, np.int32) for x in ids])


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `ids` (array of int) of every whole text. `rank_path` is a file that every executor has."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = coding_of(rank_path, pattern)
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                ids = [text_ids(coding, data[x:y].tobytes().decode("utf-8", "replace")) for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                cut = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(ids)))], [id_col, "ids"])

    own = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text"))
    return own.mapInArrow(encode, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded` (binary), the raw bytes of the ids of each row."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = coding_of(rank_path, pattern)
        for batch in batches:
            lists = batch.column(ids_col)
            cut, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            for a, b in row_slices(4 * cut.astype(np.int64), SLICE_BYTES):
                raw = [coding.decode_bytes(ids[x:y].tolist()) for x, y in zip(cut[a:b], cut[a + 1 : b + 1])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, schema)
