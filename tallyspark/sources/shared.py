"""Tables in the folder that driver and executors share: what several jobs read, and what cuts a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves a session whose executors are threads
    of this machine; on a cluster that is an error, as other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    folders: columns whose values get folders of their own.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """`df` as a table of `buckets` (default: the session's shuffle partitions) sorted by `keys`, shuffled once here; joins and groups by
    these keys read it as it lies. The catalogue entry lasts as long as the session's warehouse; the files stand in the shared folder."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    label = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(label)
    return spark.table(label)
