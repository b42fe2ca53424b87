"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`,
whatever further columns these hold and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, near_dedup, quality_rules, token_files
from tallyspark.llm.queries import table, tokenizer_path
from tallyspark.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and go; rows with a null id are judged by their text; rows are judged one by one, so repeated
    rows stay or go together; without labels only the base rules hold; long texts are judged whole; an empty table stays empty.
    """
    judged = quality_rules.quality_verdicts(docs, table(spark, sf_dir, "labels"), carry=True)
    return judged.where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8.

    Rows of one id are one document, of which the row with the least text stays; rows with a null id and documents without words
    are in no group and stay; an empty table stays empty.
    """
    groups = stored(near_dedup.near_groups(docs, size=5, percent=80, turns=1), "groups")
    gone = stored(groups.where("not kept").select("doc_id").distinct(), "gone")
    again = stored(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    small = lambda ids: F.broadcast(ids) if ids.count() <= near_dedup.MOST_BROADCAST else ids
    left = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = left.join(small(again), "doc_id", "left_semi").withColumn("_first", first).where("_first = 1")
    return left.join(small(again), "doc_id", "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than 5 % of their words in benchmark windows.

    Null and empty texts have no hit and stay; null and empty items have no window; rows are judged one by one, whatever their id;
    long texts are judged whole; an empty table stays empty.
    """
    judged = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return judged.where("not contaminated").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, at most twice.

    Null and empty texts have no words and are not taken; a null source is a source of its own; rows with a null or a repeated id are
    documents of their own; ties are drawn by the seed; an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs, carry=True, copies=True).where("times > 0")
    return mixed.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns each document's place in them.

    Null and empty texts are the end id alone; rows are written by ascending id, repeated rows one after the other; rows with a null
    id are written too; a text of any length is encoded whole; an empty table gives no rows.
    """
    manifest = token_files.write_tokens(docs, tokenizer_path())
    read = token_files.read_tokens(manifest, tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token files", tokens)]
#: The stages fit cutoffs, link components and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
