"""Collocations against plain counting, over odd rows, several cycles and filters of few cells."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations

FOLD = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD))]


def brute(rows, least, longest, held, top):
    counts, words = {}, Counter()
    for _, text, lang in rows:
        for p in pieces(text):
            own = counts.setdefault(lang or "und", Counter())
            words[lang or "und"] += len(p)
            own.update(tuple(p[i : i + m]) for m in range(1, longest + 1) for i in range(len(p) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            cover = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * b >= held * a for b in cover):
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "é", "New", "YORK", "x-ray", "漢字", " ", "😀", *("w%d" % i for i in range(40))]
    fixed = ["new york stock exchange", "machine learning", "of the", "a b c d e f"]
    rows = []
    for i in range(150):
        said = [draw.choice(fixed) if draw.random() < 0.15 else draw.choices(vocabulary, range(49, 0, -1))[0] for _ in range(draw.randint(0, 60))]
        rows.append((i if i % 9 else None, "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "!"]) for w in said), [None, "en", "en", "fr"][i % 4]))
    rows += [(1, None, "en"), (1, "", "xx"), (2, " . ", None), (3, "ha " * 3000, "en"), (3, "ha " * 3000, "en"), (4, "ha " * 10, "und")]
    rows += [(100 + i, "late bloomers come last", "de") for i in range(12)]
    return rows


@pytest.mark.parametrize("least,longest,shards,cells,top", [(8, 4, 4, None, 2000), (8, 4, 4, 64, 2000), (8, 5, 4, 256, 2000), (5, 4, 1, 512, 20), (3, 5, 3, 4096, 2000), (12, 2, 2, None, 5)])
def test_collocations(spark, least, longest, shards, cells, top):
    rows = corpus(least)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "n", "shard", "score", "length")})
    got = [tuple(r) for r in collocations.mine_collocations(docs, least, longest, 80, top, shards, cells=cells).collect()]
    assert sorted(got) == sorted(brute(rows, least, longest, 80, top))
    if least == 8:
        assert collocations.mine_collocations(docs.limit(0), least, longest).count() == 0


def test_exact_scores(spark, monkeypatch):
    """Counts near 2**62: products and sums pass 64 bits."""
    big = 2**62 - 1
    frequent = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 5)], "lang string, length int, phrase string, n long")
    words = spark.createDataFrame([("en", 2**63 - 1)], "lang string, n long")
    monkeypatch.setattr(collocations, "count_phrases", lambda *a: (frequent, words))
    [row] = collocations.mine_collocations(spark.range(0)).collect()
    assert row.score == 2_000_000 * (big - 5) // (2 * big) and row.n == 2**63 - 1


def test_words_of():
    for text in ["", " ", "a", ".A b.C", "é\tÉ", "a.", "x  y\n"]:
        data = np.frombuffer((text + "|").encode(), np.uint8)[: len(text.encode())]
        words, piece, row, prints = collocations.words_of(np.concatenate((data, data)), np.array([0, len(data), 2 * len(data), 2 * len(data)]))
        want = [w for _ in range(2) for p in pieces(text) for w in p]
        assert [w.decode() for w in words.to_pylist()] == want and row.tolist() == [0] * (len(want) // 2) + [1] * (len(want) // 2)
        assert prints.tolist() == collocations.word_hash([w.encode() for w in want]).tolist()
        assert len(set(piece.tolist())) == 2 * sum(map(bool, pieces(text)))


def test_words_are_told_apart_once():
    """Equal words of a slice share one spelling, whatever their case, and texts without words come between."""
    data = np.frombuffer("a B a;b A".encode(), np.uint8)
    words, piece, row, _ = collocations.words_of(data, np.array([0, 0, len(data), len(data)]))
    assert words.dictionary.to_pylist() == [b"a", b"b"] and words.indices.to_pylist() == [0, 1, 0, 1, 0]
    assert piece.tolist() == [1, 1, 1, 2, 2] and row.tolist() == [1] * 5


def test_phrases_of_many_words_are_numbered_anew():
    """Counts of phrases of four words where the numbers of their words pass 64 bits."""
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{i}" for i in line) for line in rng.integers(0, 70_000, (15_000, 7))] + [" ".join(f"v{i}" for i in range(k, k + 7)) for k in range(70_000)]
    lines += lines[:500] + lines[:7]
    data, langs = np.frombuffer(".".join(lines).encode(), np.uint8), pa.array(["en"])
    known = collocations.Filters(1 << 20, 4, 1)
    known.full[:], known.since = 0, {k: np.zeros(1 << 18, np.uint8) for k in (1, 2, 3)}
    got = {}
    for batch in collocations.phrases_in(data, np.array([0, len(data)]), langs, known, np.zeros(1 << 20, np.uint32), 4, 4, 4):
        got |= {x: n for x, length, n in zip(*(batch.column(c).to_pylist() for c in ("phrase", "length", "n"))) if length == 4}
    words = [x.split(" ") for x in lines]
    assert got == Counter(" ".join(x[k : k + 4]) for x in words for k in range(4))
