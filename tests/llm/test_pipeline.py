"""The stages on a small table: what each decides takes effect."""

import random
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
            before = docs.count()
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.agg(F.sum("n_tokens")).first()[0] == out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_near_duplicates_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, "other words here"), (3, "still other words"), (4, None), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, text), (0, text), (1, text), (3, "other words here"), (4, "")]
    assert P.near_duplicates(spark, docs.limit(0), SF).count() == 0


def odd_rows():
    draw = random.Random(11)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    base, passage = prose(80), prose(40)
    changed = base.split()
    changed[70] = "edit"
    again = prose(60)
    rows = [(1, base), (2, " ".join(changed)), (3, base), (4, None), (5, ""), (6, "too short"), (7, "ab " * 200), (8, passage + " " + prose(20)), (9, prose(200)), (10, prose(3000)), (11, prose(30)), (12, again), (12, again), (None, prose(60))]
    return rows, passage, {1, 9, 10, 11, 12, None}


def test_run_by_brute_force(spark, tmp_path):
    rows, passage, stay = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("kept", "size", "times", "use", "stratum", "component_id")})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("a", passage), ("b", None), ("c", "")], "item_id string, text string")
    for name, df in {"documents": docs, "labels": labels, "benchmark": benchmark}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(P.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    text = dict(rows)
    library = Tokenizer.from_file(P.tokenizer_path())
    times = Counter(r.doc_id for r in got)
    assert set(times) == stay and max(times.values()) <= 2
    sizes = {i: len(text[i].split()) for i in stay}
    assert abs(sum(sizes[i] * n for i, n in times.items()) - 1.5 * sum(sizes.values())) <= max(sizes.values())
    at = 0
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_run_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
