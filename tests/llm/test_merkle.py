"""The manifest against plain trees, over odd rows, small bands and other arities."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle, queries


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, arity=3):
    """(root, for each leaf the digests before and after it by level)"""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, own in zip(paths, at):
            first = own - own % arity
            path.append(("".join(level[first:own]), "".join(level[own + 1 : first + arity])))
        level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [own // arity for own in at]
    return level[0], paths


def manifest(rows, arity=3):
    """{(group, order, leaf): [(subroot, root, path)]} of (group, order, leaf)"""
    low = lambda x: (x is not None, x if x is not None else "")
    groups = sorted({g for g, _, _ in rows}, key=low)
    own = {g: sorted(((o, d) for h, o, d in rows if h == g), key=lambda x: ((x[0] is not None, x[0] or 0), x[1])) for g in groups}
    trees = {g: tree([d for _, d in own[g]], arity) for g in groups}
    root, above = tree([trees[g][0] for g in groups], arity)
    out = []
    for g, upper in zip(groups, above):
        out += [(g, o, d, trees[g][0], root, path + upper) for (o, d), path in zip(own[g], trees[g][1])]
    return out


def table(seed, n, groups):
    draw = random.Random(seed)
    names = [None, "", "é", "ﬀ", "😀", *(f"g{i}" for i in range(groups))]
    rows = [("hot" if draw.random() < 0.4 else draw.choice(names), draw.choice([i, i, i, None, 7]), digest(str(draw.randint(0, n)))) for i in range(n)]
    return rows


@pytest.mark.parametrize("n,groups,band,arity", [(1, 0, 8, 3), (4, 0, 8, 3), (300, 3, 1, 3), (700, 20, 2, 3), (700, 20, 8, 3), (200, 300, 3, 2)])
def test_manifest(spark, n, groups, band, arity):
    rows = table(n, n, groups)
    leaves = spark.createDataFrame(rows, "source string, doc_id long, leaf string").withColumns({c: F.lit(1) for c in ("group", "place", "size", "digest", "before", "own")})
    got = merkle.merkle_manifest(leaves, "source", "doc_id", band=band, arity=arity)
    found = [(r["source"], r.doc_id, r.leaf, r.subroot, r.root, list(zip(r.before, r.after))) for r in got.collect()]
    assert sorted(found, key=str) == sorted(manifest(rows, arity), key=str)


def test_query(spark, tmp_path):
    texts = [None, "", "a", "two\nlines", "é\n\n😀", "x" * 100_000 + "\n", "same\n", "same\n", "no feed"] * 3
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, "en" if i % 2 else None, i if i % 3 else None, 1) for i, t in enumerate(texts)]
    rows += [(None, "null\nid", "s1", "en", 1, 1), (3, "again\n", "s1", None, None, 1), (3, "again\n", "s1", None, None, 1), (5, "alone\n", "lone", None, 2, 1)]
    columns = "doc_id long, text string, source string, lang string, n_chars long, leaf int"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    forged = {}
    for i, t, s, lang, n, _ in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and t is not None
        forged[leaf_of(i, s, lang, n, t)] = leaf_of(i, s, lang, n, t.replace("\n", "") if bad else t)
    for _, i, leaf, subroot, root, path in manifest([(r[2], r[0], leaf_of(r[0], r[2], r[3], r[4], r[1])) for r in rows]):
        own = forged[leaf]
        for before, after in path:
            own = digest(before, own, after)
        want.append((i, leaf, subroot, root, digest(*(b + a for b, a in path)), own, own == root))
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}
    spark.createDataFrame(rows[:0], columns).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert queries.op11_merkle_manifest(spark, f"{tmp_path}/empty").count() == 0
