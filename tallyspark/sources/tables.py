"""Sources and sinks: period-partitioned tables, first existing file, name parsing, JSON documents, relational loads, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, period: object | None = None, period_col: str = "period") -> DataFrame:
    """A Parquet table (CSV where the path ends so), NaN as null; a period prunes partitions."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.csv(path, header=True, enforceSchema=False) if path.endswith(".csv") else reader.parquet(path)
    df = df if period is None else df.where(F.col(period_col) == period)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_table(df: DataFrame, path: str, period_col: str = "period", csv: bool = False) -> None:
    """Replaces the periods that `df` holds and leaves the others; `csv` adds a CSV copy beside it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period_col).parquet(path)
    if csv:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period_col).option("header", True).csv(f"{path}_csv")


def read_first_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first path that Spark can read as Parquet."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def route_by_name(df: DataFrame, name: str, routes: Mapping[str, str], otherwise: str = "unknown") -> DataFrame:
    """Adds `route`: of the first substring (in the given order) that the name contains, in either case."""
    out = F.lit(otherwise)
    for part, route in reversed(routes.items()):
        out = F.when(F.contains(F.lower(name), F.lit(part.lower())), route).otherwise(out)
    return df.withColumn("route", out)


def parse_file_name(df: DataFrame, name: str, pattern: str, fields: Sequence[str]) -> DataFrame:
    """Adds the pattern's groups as fields, `parsed` and a note."""
    hit = F.col(name).rlike(pattern)
    groups = {f: F.when(hit, F.regexp_extract(name, pattern, k + 1)) for k, f in enumerate(fields)}
    return df.withColumns(groups).withColumns({"parsed": F.coalesce(hit, F.lit(False)), "note": F.when(hit, "").otherwise("name does not fit")})


def read_tables_union(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of many small text tables as (source, line, cells): ragged rows keep their own number of cells, quoted cells
    their commas."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("line"))
    cells = F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), unquoted)
    return lines.withColumn("cells", F.when(F.contains("line", F.lit('"')), cells).otherwise(F.split("line", ",", -1)))


def unquoted(cell: Column) -> Column:
    """A cell without the quotes around it, doubled ones inside as one."""
    inner = F.regexp_extract(cell, r'^\s*"((?s:.*))"\s*$', 1)
    return F.when(cell.rlike(r'^\s*"(?s:.*)"\s*$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)


def json_documents(df: DataFrame, key: str, fields: Sequence[str], digits: int = 2) -> DataFrame:
    """One JSON text for each row: numbers rounded half to even, NaN and null left out."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [(F.bround(F.when(~F.isnan(f), F.col(f)), digits) if f in numbers else F.col(f)).alias(f) for f in fields]
    return df.select(key, F.to_json(F.struct(*cols)).alias("document"))


def write_json_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_relational(facts: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]], normalise=lambda c: F.upper(F.trim(c))) -> DataFrame:
    """dims: new id column -> (dimension with an `id`, its name column, the fact's name column). Resolves names by normalised
    equality (the least id of a name) and drops facts with an unresolved one."""
    for out, (dim, name, own) in dims.items():
        keys = dim.groupBy(normalise(F.col(name)).alias("_k")).agg(F.min("id").alias(out))
        facts = facts.withColumn("_k", normalise(F.col(own))).join(keys, "_k").drop("_k")
    return facts


def surrogate_ids(df: DataFrame, columns: Sequence[str], name: str = "id") -> DataFrame:
    """Distinct rows with a 64-bit id from their values: the same in every run, without an order over all rows."""
    return df.select(*columns).distinct().withColumn(name, F.xxhash64(*columns))


def append_dedup(prior: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union of both with the first row of each key: prior rows go first, then by `order`."""
    from pyspark.sql import Window

    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_new", *order))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_new")


def append_unseen(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return prior.unionByName(new.join(prior.select(key), key, "left_anti"), allowMissingColumns=True)


def read_feature_properties(spark: SparkSession, path: str, keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Attribute records of GeoJSON feature lists; `keys` adds normalised name columns."""
    found = spark.read.option("multiLine", True).json(path).select(F.explode("features.properties").alias("p")).select("p.*")
    return found.withColumns(dict(keys)) if keys else found


def rules_table(spark: SparkSession, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """canonical -> spellings as rows (canonical, alias, length): a small table for broadcast joins."""
    rows = [(name, alias, len(alias)) for name, aliases in rules.items() for alias in aliases]
    return spark.createDataFrame(rows, "canonical string, alias string, length int")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
