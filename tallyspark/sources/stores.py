"""Tables that grow: key buckets that an append rewrites one by one, and an index of letter triples for substring search.

`KeyedTable` keeps each bucket of keys in a folder of its own version. A manifest names the folder of every bucket; it is
written last, as a new version, so readers see the old table until then and a run that fails leaves it as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.tables import append_dedup


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files under a path of any store that Spark reads; none if it does not exist."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []


class KeyedTable:
    """A table in `path` with one row for each key; `buckets` folders by a hash of the keys (null keys are keys)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        named = [n for n in _folders(self.spark, f"{self.path}/manifest") if n.isdigit()]
        return sorted(int(n) for n in named if "_SUCCESS" in _folders(self.spark, f"{self.path}/manifest/{n}"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """bucket -> folder, at most one entry for each bucket."""
        have = self.versions()
        if not have:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/{have[-1] if version is None else version}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None without any."""
        held = self.manifest(version)
        folders = [f for b, f in sorted(held.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def append(self, new: DataFrame, order: Sequence[Column]) -> int:
        """Adds the rows of unknown keys (of several rows of a key the first by `order`) and returns the version. Buckets without a
        row of `new` keep their files. Two appends at once: the second to finish fails, as its version is taken."""
        held = self.manifest()
        version = max(self.versions(), default=0) + 1
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())  # at most one number for each bucket
        old = self.read(touched)
        merged = append_dedup(new.limit(0) if old is None else old, new, self.keys, order)
        folder = f"data/{version}"
        merged.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        held |= {b: f"{folder}/bucket={b}" for b in touched}
        self.spark.createDataFrame(sorted(held.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{self.path}/manifest/{version}")
        return version


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct triples of letters of a text in lower case."""
    low = F.lower(text)
    return F.when(F.char_length(low) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - GRAM + 1), lambda i: F.substr(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class GramIndex:
    """An inverted index in `path`: which keys hold a letter triple in one of `columns`; folders by a hash of the triple.

    A needle of three letters or more reads the folders of its triples only; candidates hold all of them in one column and are
    then searched letter by letter. Shorter needles search all rows. An append adds files and touches none.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str], folders: int = 64):
        self.spark, self.path, self.key, self.columns, self.folders = spark, path.rstrip("/"), key, list(columns), folders

    def _folder(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    def append(self, rows: DataFrame) -> None:
        each = F.flatten(F.array(*[F.transform(_grams(F.coalesce(c, F.lit(""))), lambda g: F.struct(F.lit(i).alias("column"), g.alias("gram"))) for i, c in enumerate(self.columns)]))  # noqa: B023
        grams = rows.select(F.col(self.key), F.inline(each)).withColumn("folder", self._folder(F.col("gram")))
        # the key's hash keeps a common triple from one task
        grams.repartition("folder", F.pmod(F.xxhash64(self.key), F.lit(16))).sortWithinPartitions("folder", "gram").write.mode("append").partitionBy("folder").parquet(self.path)

    def candidates(self, needle: str) -> DataFrame:
        """Keys that hold all triples of the needle in one column."""
        low = needle.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._folder(F.col("gram"))).distinct().collect()]
        index = self.spark.read.parquet(self.path).where(F.col("folder").isin(*folders) & F.col("gram").isin(*wanted))
        return index.groupBy(self.key, "column").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(self.key).distinct()

    def search(self, rows: DataFrame, needle: str) -> DataFrame:
        """The rows that hold the needle, in either case, in one of the columns."""
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
        if len(needle) >= GRAM:
            rows = rows.join(self.candidates(needle), self.key, "left_semi")
        return rows.where(hit)
