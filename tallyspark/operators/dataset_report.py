"""A dataset's report from states that merge: each file's rows are read once, when it is added.

Distinct regions, zones and contests are counted exactly: every name gets a dense number when it is first seen, and a file's state
holds its numbers as bitmaps. Merging is a sum of counts and an or of bitmaps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import selection
from tallyspark.sources.stores import _folders

NAMES, TOTALS, BITMAPS = "kind string, name string, id long", "file string, measure string, n long", "file string, kind string, part long, bits binary"


class DatasetReport:
    """The states of a dataset's files in `path`, and their report.

    entities: what is counted distinct, name -> columns of its key (a key with a null is none); features: columns whose nulls are
    counted; old, new: boolean columns of the two rounds; quality and coverage: columns, as all of these, of the rows that are added.
    """

    def __init__(self, spark: SparkSession, path: str, entities: Mapping[str, Sequence[str]], features: Sequence[str], old: str = "has_old", new: str = "has_new", quality: str = "quality", coverage: str = "coverage", least: float = 0.85):
        self.spark, self.path, self.entities, self.features = spark, path.rstrip("/"), dict(entities), list(features)
        self.rounds, self.quality, self.coverage, self.least = (old, new), quality, coverage, least

    def _read(self, name: str, schema: str) -> DataFrame:
        if not _folders(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def files(self) -> DataFrame:
        return self._read("totals", TOTALS).select("file").distinct()

    def add(self, file: str, rows: DataFrame) -> None:
        """Reads the rows of a file; a file that is there already is refused. The totals are written last and make it count."""
        if not self.files().where(F.col("file") == file).isEmpty():
            raise ValueError(f"{file} is in the report")
        keys = [F.struct(F.lit(kind).alias("kind"), F.when(~F.array_contains(F.transform(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNull()), True), F.concat(*[F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns])).alias("name")) for kind, columns in self.entities.items()]
        seen = rows.select(F.inline(F.array(*keys))).where("name is not null").distinct()
        known = self._read("names", NAMES)
        last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = selection.ordered(seen.join(known, ["kind", "name"], "left_anti"), [], [F.asc("kind"), F.asc("name")], "id")
        fresh.select("kind", "name", (F.col("id") + last).alias("id")).write.mode("append").parquet(f"{self.path}/names")
        numbered = seen.join(self._read("names", NAMES), ["kind", "name"])
        bits = numbered.groupBy("kind", F.bitmap_bucket_number("id").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        bits.select(F.lit(file).alias("file"), "kind", "part", "bits").write.mode("append").parquet(f"{self.path}/bitmaps")
        old, new = (F.coalesce(c, F.lit(False)) for c in self.rounds)
        counts = {"rows": F.lit(True), "both_rounds": old & new, "one_round": old != new, "low_quality": F.col(self.quality) == "low", "low_coverage": F.col(self.coverage) < self.least, **{f"missing {f}": F.col(f).isNull() for f in self.features}}
        one = rows.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
        long = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").alias("n")) for n in counts])))
        long.select(F.lit(file).alias("file"), "measure", "n").write.mode("append").parquet(f"{self.path}/totals")

    def report(self, name: str, top: int = 3) -> DataFrame:
        """One row: dataset, rows, a number of each entity, both_rounds, low_quality, notes. Only states are read."""
        totals = self._read("totals", TOTALS)
        of = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(m)
        one = totals.agg(*[of(m) for m in ("rows", "both_rounds", "one_round", "low_quality", "low_coverage", *[f"missing {f}" for f in self.features])])
        # bitmaps of a file without totals belong to an add that failed
        whole = self._read("bitmaps", BITMAPS).join(totals.select("file").distinct(), "file", "left_semi")
        merged = whole.groupBy("kind", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
        held = merged.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.bitmap_count("bits"))), F.lit(0)).alias(k) for k in self.entities])
        some = F.array_sort(F.array(*[F.struct((-F.col(f"`missing {f}`")).alias("neg"), F.lit(f).alias("f")) for f in self.features]))
        share = lambda x: F.concat(x["f"], F.lit("="), F.floor(-100 * x["neg"] / F.col("rows") + 0.5).cast("string"), F.lit("%"))
        notes = [
            F.when(F.col("one_round") > 0, F.concat(F.col("one_round").cast("string"), F.lit(" rows of one round only"))),
            F.when(F.col("low_coverage") > 0, F.concat(F.col("low_coverage").cast("string"), F.lit(f" rows with a coverage below {self.least:g}"))),
            F.when(F.lit(bool(self.features)), F.concat(F.lit("most missing: "), F.array_join(F.transform(F.slice(some, 1, top), share), ", "))),
        ]
        said = F.when(F.col("rows") == 0, "no rows").otherwise(F.concat_ws("; ", *notes))
        return one.join(held).select(F.lit(name).alias("dataset"), "rows", *self.entities, "both_rounds", "low_quality", said.alias("notes"))
