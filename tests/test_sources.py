"""Sinks and sources that need files."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import relational as R
from tallyspark.sources import tables as S


def test_periods_coexist(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.createDataFrame([(1, "a", 1.0), (2, "b", float("nan"))], "period int, k string, x double"), path, csv=True)
    S.write_table(spark.createDataFrame([(2, "c", 3.0)], "period int, k string, x double"), path)
    assert sorted((r.period, r.k) for r in S.read_table(spark, path).collect()) == [(1, "a"), (2, "c")]
    assert [r.k for r in S.read_table(spark, path, period=1).collect()] == ["a"]


def test_nan_becomes_null_and_missing_paths_raise(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(str(tmp_path / "n"))
    assert S.read_first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "n")]).count() == 2
    assert S.read_table(spark, str(tmp_path / "n")).where("x is null").count() == 1
    with pytest.raises(FileNotFoundError):
        S.read_first_existing(spark, [str(tmp_path / "no")])


def test_ragged_tables_and_features(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1\n")
    (tmp_path / "b.csv").write_text("q,r,s\n")
    got = {(r.source, len(r.cells)) for r in S.read_tables_union(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("a.csv", 2), ("a.csv", 1), ("b.csv", 3)}
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"name": "A & B", "code": 1}}, {"properties": {"name": "C", "code": 2}}]}))
    assert {r.k for r in S.read_feature_properties(spark, str(tmp_path / "f.json"), {"k": F.upper("name")}).collect()} == {"A & B", "C"}


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.125, None), (2, float("nan"), "t")], "k int, x double, s string")
    assert [json.loads(r.document) for r in S.json_documents(df, "k", ["x", "s"]).orderBy("k").collect()] == [{"x": 0.12}, {"s": "t"}]
    S.write_json_documents(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_column_guards(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(ValueError):
        R.require_columns(df, ["a", "z"])
    assert R.drop_empty_columns(df).columns == ["a"] and R.project_existing(df, ["b", "z"]).columns == ["b", "a"]
