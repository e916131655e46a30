"""The corpus pipeline: documents are judged, thinned, cleared of test passages, mixed and sharded.

Every stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps with the columns of
``documents``; the last adds ``shard`` and ``slot``. Each works on all its predecessor kept,
which lies as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import stored, table
from sigspark.llm.decontaminate import without_leaks
from sigspark.llm.minhash import one_of_each
from sigspark.llm.mixing import mixed
from sigspark.llm.quality import scored
from sigspark.llm.sharding import into_shards

#: No engine of plain SQL trains the classifier or tiles strings; tests compare with brute force.
ORACLE_SQL = None
SHARDS = 40


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views find good and not toxic."""
    judged = scored(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return judged.filter("kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8."""
    return one_of_each(docs)


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return mixed(docs, words, F.col("source"), [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it."""
    return into_shards(docs, SHARDS).select("row.*", "shard", "slot")


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_each),
    ("decontamination", keep_untested),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
