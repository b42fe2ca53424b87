"""Keyed tables, the index of letter triples and bucketed joins."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import dataset_report, relational
from tallyspark.sources import stores
from tallyspark.sources.shared import stored_bucketed


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    store = stores.KeyedTable(spark, str(tmp_path), ["k"], buckets=16)
    assert store.read() is None and store.versions() == []
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert store.append(first.unionByName(first.withColumn("v", F.lit("older"))), [F.asc("v")]) == 1
    assert store.read().count() == 1000 and store.read().where("v <> 'old'").isEmpty()
    before, held = files(tmp_path), store.manifest()
    new = spark.createDataFrame([(5, "new"), (2000, "b"), (2000, "a"), (None, "null"), (None, "nil")], "k long, v string")
    assert store.append(new, [F.asc("v")]) == 2
    after, changed = store.manifest(), {b for b, f in store.manifest().items() if held.get(b) != f}
    assert 0 < len(changed) <= 3 and {b: after[b] for b in held if b not in changed} == {b: f for b, f in held.items() if b not in changed}
    assert before.items() <= files(tmp_path).items()
    rows = {r.k: r.v for r in store.read().collect()}
    assert len(rows) == 1002 and (rows[5], rows[2000], rows[None]) == ("old", "a", "nil")
    assert store.read(version=1).count() == 1000


def test_keyed_table_survives_a_failed_append(spark, tmp_path):
    store = stores.KeyedTable(spark, str(tmp_path), ["k"], buckets=4)
    store.append(spark.range(50).select(F.col("id").alias("k")), [F.asc("k")])
    bad = spark.range(60).select(F.when(F.col("id") < 55, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("k"))
    with pytest.raises(Exception, match="no"):
        store.append(bad, [F.asc("k")])
    assert store.versions() == [1] and store.read().count() == 50


def test_gram_index(spark, tmp_path):
    texts = ["Northern Ring", "ring", "RINGS of fire", None, "", "rin", "in g", "r i n g", "Über-Ring", "gnir"]
    rows = spark.createDataFrame([(i, t, "string" if i == 6 else None) for i, t in enumerate(texts)], "k long, a string, b string")
    index = stores.GramIndex(spark, f"{tmp_path}/index", "k", ["a", "b"], folders=8)
    index.append(rows.where("k < 5"))
    index.append(rows.where("k >= 5"))
    for needle in ("ring", "RIN", "über", "in", "zzz", ""):
        want = {i for i, t in enumerate(texts) if needle.lower() in (t or "").lower() and t is not None or i == 6 and needle.lower() in "string"}
        assert {r.k for r in index.search(rows, needle).collect()} == want, needle
    plan = index.candidates("ring")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters")[1][:60]


def test_bucketed_joins_do_not_move_the_spine(spark):
    spine = stored_bucketed(spark.range(500).select(F.col("id").alias("k")), "spine", ["k"], 4)
    tables = [stored_bucketed(spark.range(0, 500, i + 2).select(F.col("id").alias("k"), F.lit(i).alias(f"v{i}")), "side", ["k"], 4) for i in range(8)]
    found = relational.multi_left_join(spine, [(t.hint("merge"), ["k"]) for t in tables])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 8 and "Exchange" not in plan
    held = {r.k: r.n for r in found.select("k", sum((F.col(f"v{i}").isNotNull().cast("int") for i in range(8)), F.lit(0)).alias("n")).collect()}
    assert held == {k: sum(k % (i + 2) == 0 for i in range(8)) for k in range(500)}


def test_dataset_report_merges_states(spark, tmp_path):
    make = lambda: dataset_report.DatasetReport(spark, str(tmp_path), {"regions": ["region"], "zones": ["region", "zone"]}, ["x", "y"])
    columns = "region string, zone string, has_old boolean, has_new boolean, quality string, coverage double, x double, y double"
    first = [("a", "1", True, True, "low", 0.5, 1.0, None), ("a", "1", True, False, "high", None, None, None), ("b", None, None, None, None, 0.9, 1.0, 1.0), ("a:1", "1", False, True, "low", 1.0, 1.0, 1.0)]
    second = [("a", "2", True, True, "low", 0.1, None, None), ("c", "1", True, True, "high", 1.0, 1.0, 1.0), (None, "1", True, True, "high", 1.0, 1.0, 1.0)]
    source = spark.createDataFrame(first, columns)
    source.write.parquet(f"{tmp_path}/first.parquet")
    make().add("first", spark.read.parquet(f"{tmp_path}/first.parquet"))
    os.rename(f"{tmp_path}/first.parquet", f"{tmp_path}/gone.parquet")
    make().add("second", spark.createDataFrame(second, columns))
    assert tuple(make().report("d").first()) == ("d", 7, 4, 4, 4, 3, "2 rows of one round only; 2 rows with a coverage below 0.85; most missing: y=43%, x=29%")
    with pytest.raises(ValueError):
        make().add("second", source)
    empty = dataset_report.DatasetReport(spark, f"{tmp_path}/empty", {"regions": ["region"]}, ["x"])
    assert tuple(empty.report("none").first()) == ("none", 0, 0, 0, 0, "no rows")
