"""Null and repeated ids: rows are judged one by one, whatever their id."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, quality_classifier, quality_rules, secret_scan


@pytest.fixture(scope="module")
def both(spark):
    """(rows by unique ids, the same rows by odd ids, unique id -> odd id)"""
    draw = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(30))
    said = [None, "", "password = abcdefgh1234", passage, f"so {passage} it is", "a b c d e " * 20] + [" ".join(draw.choices("abcdefgh", k=draw.randint(5, 80))) for _ in range(20)]
    rows = [(i, draw.choice(said), draw.choice(["en", None]), draw.choice(["s", "t", None])) for i in range(60)]
    odd = {i: draw.choice([None, None, 1, 2, i]) for i in range(60)}
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(odd[r[0]], *r[1:]) for r in rows], schema), odd, passage


def same(found, judged, odd):
    columns = [c for c in found.columns if c != "doc_id"]
    return Counter((odd[r.doc_id], str([r[c] for c in columns])) for r in found.collect()) == Counter((r.doc_id, str([r[c] for c in columns])) for r in judged.collect())


def test_quality_rules(spark, both):
    own, other, odd, _ = both
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert same(quality_rules.quality_verdicts(own, labels), quality_rules.quality_verdicts(other, labels), odd)


def test_decontamination(spark, both):
    own, other, odd, passage = both
    benchmark = spark.createDataFrame([("b1", passage), ("b2", "c d e"), (None, "x"), ("b3", None), ("b1", passage)], "item_id string, text string")
    assert same(decontaminate.find_contamination(own, benchmark), decontaminate.find_contamination(other, benchmark), odd)


def test_secret_scan(both):
    own, other, odd, _ = both
    pick = lambda d: secret_scan.scan_secrets(d).select("doc_id", "base")
    assert same(pick(own), pick(other), odd)


def test_quality_classifier(spark, both):
    _, other, _, _ = both
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    held_out = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    got = quality_classifier.quality_scores(other, labels, held_out).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in other.collect()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_mixing(both):
    own, other, odd, _ = both
    got = mixing.mix_sources(other, copies=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(odd.values()) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix_sources(other, copies=True).collect()))
    targets = lambda d: {(r.source_size, r.target) for r in mixing.mix_sources(d, copies=True).collect()}
    assert targets(own) == targets(other)
