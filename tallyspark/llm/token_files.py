"""Token ids as flat binary files.

Format, for each part: `<part>.bin` holds unsigned little-endian ids (16 bits if the vocabulary allows it, else 32), one
document after the other, each closed by the end id; `<part>.idx` holds 64-bit offsets, one more than documents, counted in
ids from the part's start; `<part>.ids` holds the documents' ids (64 bits; null: the least value). Parts are in ascending
order of document id, and a part's base in the whole sequence is the prefix sum of the parts before it. Readers map the files
into memory where the store is a file system.

Executors write to the shared folder under a name of their attempt; only parts named in the manifest count, so a task that
is run again leaves no wrong file behind.

Nulls and odd input: a null or empty text has the end id alone; a null id sorts first; repeated ids are documents of their
own, ordered by a hash of the text; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, row_slices, span_hash, stored, text_view, total_bytes

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID, PART_BYTES, MOST_PART_BYTES, SLICE_BYTES, JOINED_BYTES = 2, 8 << 20, 512 << 20, 8 << 20, 256 << 10
#: A worker lives on after its task, and its words (about 45 bytes each) with it.
KEPT_WORDS, OLD_SHARE = 200_000, 4
NO_ID = np.iinfo(np.int64).min
#: A word that can be encoded apart from its text: without white space, but for a line feed at its start.
PLAIN_WORD = r"\A\n?[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+\z"
#: The letter that stands for each byte.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
MANIFEST = "part int, path string, docs long, tokens long"


class Words:
    """Words and their ids in flat arrays; each word is led by a blank unless it starts with a line feed.

    Words are found by fingerprint and then compared. Unknown ones are encoded by the library in one text and told apart by the tokens
    that begin with a blank or a line feed. The memory is bounded: of the words that one call alone has asked for, the latest `most` stay,
    of those asked for again the first OLD_SHARE times as many; of these, ones not asked for since the memory was last full go.
    """

    def __init__(self, tokenizer: Tokenizer, kind: np.dtype, most: int):
        from tokenizers import Tokenizer

        self.plain, self.kind, self.most = Tokenizer(tokenizer.model), kind, most  # without the added tokens
        self.plain.pre_tokenizer = tokenizer.pre_tokenizer
        if tokenizer.normalizer:
            self.plain.normalizer = tokenizer.normalizer
        vocabulary = self.plain.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] in (BYTE_LETTERS[32], BYTE_LETTERS[10])]] = True
        self.words, self.prints, self.place = pa.array([], pa.string()), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.cut = np.zeros(0, kind), np.zeros(1, np.int64)
        self.again, self.lately = np.zeros(0, bool), np.zeros(0, bool)

    def __len__(self) -> int:
        """Words that one call alone has asked for."""
        return len(self.words) - len(self.old)

    @property
    def old(self) -> np.ndarray:
        """Places of the words asked for again."""
        return np.flatnonzero(self.again)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each of `words`, which are distinct; unknown ones are learnt."""
        data, offsets = text_view(words)
        prints, place = span_hash(data, offsets), np.full(len(words), -1, np.int64)
        if len(self.prints):
            at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
            held = np.flatnonzero(self.prints[at] == prints)
            held = held[pc.equal(self.words.take(pa.array(self.place[at[held]])), words.take(pa.array(held))).to_numpy(zero_copy_only=False)]
            place[held] = self.place[at[held]]
            self.again[place[held]] = self.lately[place[held]] = True
        new = np.flatnonzero(place < 0)
        place[new] = len(self.words) + np.arange(len(new))
        if len(new):
            self.learn(words.take(pa.array(new)), prints[new])
        return place

    def learn(self, words: pa.Array, prints: np.ndarray) -> None:
        ids = []
        for a, b in row_slices(text_view(words)[1], JOINED_BYTES):
            joined = (" " + " ".join(words.slice(a, b - a).to_pylist())).replace(" \n", "\n")
            ids.append(np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind))
        ids = np.concatenate(ids)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(words):
            raise ValueError("the tokenizer does not cut before each blank and line feed")
        order = np.argsort(prints)
        at = np.searchsorted(self.prints, prints[order])
        self.prints, self.place = np.insert(self.prints, at, prints[order]), np.insert(self.place, at, len(self.words) + order)
        self.words, self.ids, self.cut = pa.concat_arrays([self.words, words]), np.concatenate((self.ids, ids)), np.concatenate((self.cut[:-1], self.cut[-1] + begin, [self.cut[-1] + len(ids)]))
        self.again, self.lately = (np.concatenate((x, np.zeros(len(words), bool))) for x in (self.again, self.lately))

    def forget(self) -> None:
        """Leaves as much as the bounds allow."""
        if len(self) <= self.most and len(self.old) <= OLD_SHARE * self.most:
            return
        keep = self.again.copy()
        if len(self.old) > OLD_SHARE * self.most:
            keep &= self.lately
            keep[np.flatnonzero(keep)[OLD_SHARE * self.most // 2 :]] = False
            self.lately[:] = False
        keep[np.flatnonzero(~self.again)[-self.most :]] = True
        size = np.diff(self.cut)[keep]
        cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        self.ids, self.cut = self.ids[np.repeat(keep, np.diff(self.cut))], cut
        self.words, self.again, self.lately = self.words.filter(pa.array(keep)), self.again[keep], self.lately[keep]
        left = keep[self.place]
        self.prints, self.place = self.prints[left], (np.cumsum(keep) - 1).astype(np.int32)[self.place[left]]


class WordEncoder:
    """Library encoding of Arrow texts with a bounded memory of words: each distinct word of a batch is looked up once.

    A byte-level pre-tokenizer always cuts before a lone blank or line feed, so the ids of a text are those of its words put
    together, each with the blank or line feed before it. Texts with two white-space characters side by side or white space
    at the end, and texts that hold an added token, are encoded in one piece.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([] if end_id is None else [end_id], self.type).tobytes()
        self.known = Words(self.whole, self.type, KEPT_WORDS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each closed by the end id; offsets)."""
        texts = texts.fill_null("")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat, heads, n = split.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets[:-1] - offsets[0], len(texts)
        inner = np.ones(len(flat), bool)
        inner[heads] = False
        coded, count = flat.filter(pa.array(inner)).dictionary_encode(), np.diff(offsets) - 1
        words = coded.indices.to_numpy().astype(np.int64)
        plain = pc.match_substring_regex(coded.dictionary, PLAIN_WORD).to_numpy(zero_copy_only=False)
        odd = np.zeros(n, bool)
        odd[np.repeat(np.arange(n), count)[~plain[words]]] = True
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        words, count = words[~np.repeat(odd, count)], np.where(odd, 0, count)
        place = np.zeros(len(plain), np.int64)
        place[plain] = self.known.find(coded.dictionary.filter(pa.array(plain)))
        begin = [self._ids(x if whole else y) for whole, x, y in zip(odd, texts.to_pylist() if odd.any() else [None] * n, flat.take(pa.array(heads)).to_pylist())]
        # one piece for each first word, inner word and end, in order
        held, size = self.known.ids, np.diff(self.known.cut)
        order, middle = np.empty(len(words) + 2 * n, np.int64), np.ones(len(words) + 2 * n, bool)
        last = np.cumsum(count + 2) - 1
        first = last - count - 1
        order[last], order[first] = len(size) + n, len(size) + np.arange(n)
        middle[last] = middle[first] = False
        order[middle] = place[words]
        size = np.concatenate((size, np.fromiter(map(len, begin), np.int64, n) // self.type.itemsize, [len(self.end) // self.type.itemsize]))
        start, long = (np.cumsum(size) - size)[order], size[order]
        to = np.cumsum(long)
        at = np.repeat((start - to + long).astype(np.int32), long)  # SLICE_BYTES bound the ids of a call, but for a longer single text
        at += np.arange(len(at), dtype=np.int32)
        ids = np.concatenate((held, np.frombuffer(b"".join(begin) + self.end, self.type)))[at]
        self.known.forget()
        return ids, np.concatenate((np.zeros(1, np.int64), to[last]))


def encoder_of(path: str, end_id: int) -> WordEncoder:
    """The worker's encoder for `path`; workers serve many tasks, and words learnt in one help the next."""
    memory = sys.modules.setdefault("tallyspark_worker", types.ModuleType("tallyspark_worker")).__dict__
    key = f"{path}:{end_id}"
    if key not in memory:
        memory[key] = WordEncoder(path, end_id)
    return memory[key]


def part_bytes(size: int) -> int:
    """Bytes of text to a part: grows with the square root of the input, so that neither the parts nor their number get out of hand."""
    return min(MOST_PART_BYTES, max(PART_BYTES, 500 * int(size**0.5)))


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write the files; returns the manifest: part, path, docs, tokens, base."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own.withColumn("hash", F.xxhash64("text"))  # rows of one id, or of none, need not share a part
    _, size = total_bytes(own, "text")
    folder = new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = encoder_of(tokenizer_path, end_id), None
        at, offsets, ids = 0, [np.zeros(1, np.int64)], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if store is None:
                store, root = pa.fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                path = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{root}/{path}.bin")
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
            texts = batch.column("text")
            for a, b in row_slices(text_view(texts)[1], SLICE_BYTES):
                tokens, cut = encoder.encode(texts.slice(a, b - a))
                out.write(tokens.tobytes())
                offsets.append(cut[1:] + at)
                at += len(tokens)
        if store is not None:
            out.close()
            for name, values in (("idx", offsets), ("ids", ids)):
                with store.open_output_stream(f"{root}/{path}.{name}") as out:
                    out.write(np.concatenate(values).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": f"{folder}/{path}", "docs": sum(map(len, ids)), "tokens": at}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    parts = max(1, -(-size // part_bytes(size)))
    dealt = own.repartitionByRange(parts, "doc_id", "hash") if parts > 1 else own.coalesce(1)
    manifest = stored(dealt.sortWithinPartitions("doc_id", "hash", "text").mapInArrow(write, MANIFEST), "manifest")
    # prefix sums in two steps: over blocks of 1,024 parts, then inside each block
    before = lambda *key: Window.partitionBy(*key).orderBy(*(["part"] if key else ["block"])).rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("block", F.shiftright("part", 10))
    blocks = manifest.groupBy("block").agg(F.sum("tokens").alias("held")).withColumn("below", F.coalesce(F.sum("held").over(before()), F.lit(0)))
    manifest = manifest.join(F.broadcast(blocks.select("block", "below")), "block")
    return manifest.select("part", "path", "docs", "tokens", (F.col("below") + F.coalesce(F.sum("tokens").over(before("block")), F.lit(0))).alias("base"))


def read_tokens(manifest: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32-bit little-endian)."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"

    def load(uri: str, dtype: str) -> np.ndarray:
        store, path = pa.fs.FileSystem.from_uri(uri)
        if isinstance(store, pa.fs.LocalFileSystem):
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        with store.open_input_stream(path) as file:
            return np.frombuffer(file.read(), dtype)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                tokens, offsets, ids = load(f"{path}.bin", kind), load(f"{path}.idx", "<i8"), load(f"{path}.ids", "<i8")
                for a in range(0, len(ids), 500):
                    cut = np.array(offsets[a : a + 501])
                    own = [tokens[x:y].astype("<u4").tobytes() for x, y in zip(cut, cut[1:])]
                    keys = np.array(ids[a : a + len(own)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("path", "base", "part")
    n = max(1, min(manifest.count(), 100_000))
    return files.repartitionByRange(n, "part").select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
