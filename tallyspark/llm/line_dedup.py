"""Line de-duplication against levelled, sorted runs of line hashes.

Documents arrive in batches of ascending id. A run is a table of line hashes, bucketed and sorted by hash; each new batch reduces
its lines to one row for each hash (with the least document), merge-anti-joins the runs, and adds what is new as a run of level 0.
When a level holds `fan` runs they are merged into one of the next level, so a batch meets a logarithmic number of runs. Runs are
shuffled when they are written and never again: a batch is dealt by the buckets of the runs. The first document to hold a key
keeps all its lines with it; later ones lose them.

Keys are lines without `[ \\t-\\r]` at both ends and with A-Z lower-cased; keys of fewer than `least` code points never count. Two
64-bit hashes stand for a key, in every step. Only lines of keys that repeat are joined to their keys, and of these the ones with a
thousandth of a batch's lines, so at most 1,000, are broadcast; a line in a third of all documents meets no single task.

Nulls and odd input: a null or empty text is one empty line; a null id comes after all others; rows of one id are one document
for the choice of the first holder; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, hot_join, new_path, stored

LAST_ID = 2**63 - 1
KEY = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Array of the keys of a text's lines."""
    return F.transform(F.split(text, "\n", -1), lambda line: fold(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))))


class Runs:
    """The levelled runs: each a table (h1, h2) in the shared folder, bucketed by both and sorted, distinct, disjoint from all others."""

    def __init__(self, spark: SparkSession, fan: int):
        self.spark, self.fan, self.levels = spark, fan, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, keys: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        dealt = keys.select(*KEY).repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_path(self.spark, "run")).option("compression", "zstd").saveAsTable(name)
        return name

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of `batch` whose key no run holds: one merge anti join for each run."""
        for run in (r for level in reversed(self.levels) for r in level):
            batch = batch.hint("merge").join(self.spark.table(run), KEY, "left_anti")
        return batch

    def add(self, new: DataFrame) -> None:
        self.levels[0].append(self.write(new))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan:
                merged = self.write(reduce(DataFrame.unionByName, map(self.spark.table, level)))
                self.drop(level)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def drop(self, runs: list[str]) -> None:
        """Forget tables; the shared folder keeps their files, as it keeps all others."""
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def drop_repeated_lines(docs: DataFrame, least: int = 10, batches: int = 4, fan: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, n_lines, n_dropped, kept (the lines that stay, joined by line feeds)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own.withColumn("at", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("t", F.xxhash64("text"))
    shares = [i / batches for i in range(1, batches)]
    edges = sorted(set(own.agg(F.percentile_approx("at", F.lit(shares), 10_000)).first()[0] or [])) if shares else []
    turn = reduce(lambda n, edge: n + (F.col("at") > edge).cast("int"), edges, F.lit(0))
    lines = own.select(turn.alias("turn"), "at", "t", F.posexplode(line_keys(F.col("text"))).alias("line", "key")).where(F.char_length("key") >= least)
    lines = stored(lines.select("turn", "at", "t", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")), "lines", "turn")
    runs, dropped = Runs(docs.sparkSession, fan), []
    for k in range(len(edges) + 1):
        batch = lines.where(F.col("turn") == k).drop("turn")  # a folder of its own
        firsts = stored(batch.groupBy(*KEY).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")), "firsts")
        fresh = stored(runs.unseen(firsts), "fresh")
        seen = firsts.hint("merge").join(fresh.select(*KEY), KEY, "left_anti") if k else fresh.limit(0)
        again = seen.withColumn("first", F.lit(None).cast("long")).unionByName(fresh.where("first < last")).select(*KEY, "first", "n")
        lost = hot_join(batch, stored(again, "again"), KEY).where(F.col("first").isNull() | (F.col("first") < F.col("at")))
        dropped.append(stored(lost.select("at", "t", "line"), "dropped"))
        runs.add(fresh)
    for level in runs.levels:
        runs.drop(level)
    gone = reduce(DataFrame.unionByName, dropped).groupBy("at", "t").agg(F.collect_set("line").alias("gone"))
    joined = own.join(gone, ["at", "t"], "left").select("doc_id", F.split("text", "\n", -1).alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    out = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), stays.alias("stays"))
    return out.select(F.col("doc_id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_dropped"), F.array_join("stays", "\n").alias("kept"))
