"""Delimited recording files and the partitioned corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark import schema
from sigspark.operators.chunks import attach, lengths, unkeyed, with_chunk
from sigspark.operators.index import with_index

# Tasks per core that list a tree of folders.
LISTINGS = 4
_LISTINGS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def separator(choice: str) -> str:
    """``comma``, ``tab``, or the first character of any other text."""
    return {"comma": ",", "tab": "\t"}.get(choice, choice[:1])


def few_listings(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """Load files with some listing tasks per core instead of one per folder, of which there may be 10,000."""
    tasks, before = LISTINGS * spark.sparkContext.defaultParallelism, spark.conf.get(_LISTINGS)
    spark.conf.set(_LISTINGS, min(tasks, int(before)))
    try:
        return load()
    finally:
        spark.conf.set(_LISTINGS, before)


def read_signals(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    sf_ecg: float | None = None,
    layout: str = "files",
) -> DataFrame:
    """Recording files ``Time,Voltage,Peak`` as a signal.

    ``layout`` says where the recording's name is: in the stem of its one file
    (``files``), in a ``recording_id=`` folder (``folders``), or in a first column
    (``table``). With a known sampling rate the position follows from the time; otherwise
    rows are numbered along the time, rows of one time by file, value and peak, so that a
    retry numbers alike. A malformed row fails the read.
    """
    name = T.StructField("recording_id", T.StringType())
    samples = schema.SAMPLE_FILE.fields
    fields = {"files": samples, "folders": [*samples, name], "table": [name, *samples]}[layout]
    reader = (
        spark.read.schema(T.StructType(fields)).option("header", True).option("sep", sep)
        .option("mode", "FAILFAST").option("pathGlobFilter", "*.csv")
    )
    raw = few_listings(spark, lambda: reader.csv(path))
    if layout == "files":
        raw = raw.withColumn("recording_id", F.regexp_replace("_metadata.file_name", r"\.csv$", ""))
    rows = raw.select(
        "recording_id", F.col("Time").alias("t"), F.col("Voltage").alias("v"), F.col("Peak").alias("peak"),
        F.col("_metadata.file_path").alias("_file"),
    )
    if sf_ecg is not None:
        rows = rows.withColumn("idx", F.rint(F.col("t") * sf_ecg).cast("bigint") + 1)
    else:
        rows = with_index(rows, ["recording_id"], ["t", "_file", "v", "peak"])
    return rows.select("recording_id", "idx", "t", "v", "peak")


def ordered(signal: DataFrame, *leading: str) -> DataFrame:
    """Rows in time order for writing, in partitions of even size.

    Range partitioning cuts a hot recording over several files, each a stretch of it.
    """
    keys = [*leading, "recording_id", "idx"]
    return signal.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_signals(signal: DataFrame, path: str, sep: str = ",", layout: str = "table") -> None:
    """Delimited text with CRLF line ends: ``Time``, ``Voltage``, ``Peak``.

    ``table`` puts the recording's name in a first column and writes few large files;
    ``folders`` writes the three columns only, in a folder per recording, for tools that
    want recordings apart.
    """
    rows = ordered(signal).select(
        "recording_id", F.col("t").alias("Time"), F.col("v").alias("Voltage"), F.col("peak").alias("Peak")
    )
    writer = rows.write.option("header", True).option("sep", sep).option("lineSep", "\r\n")
    if layout == "folders":
        writer = writer.partitionBy("recording_id")
    writer.csv(path)


def write_corpus(signal: DataFrame, recordings: DataFrame, path: str) -> None:
    """Signal with its catalogue columns as Parquet, in ``split=/activity=`` folders.

    Sorted by folder, recording and position over even ranges, so a folder of any size is
    written by as many tasks as it needs and each task writes few files. The catalogue must
    name every recording once (checked by a job), or a recording would be in two splits.
    """
    if not recordings.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError("the catalogue names a recording more than once")
    known = recordings.withColumnRenamed("recording_id", "_id")
    counted = lengths(signal)
    catalogue = counted.join(known, counted["recording_id"].eqNullSafe(known["_id"]), "left").drop("_id")
    joined = unkeyed(attach(with_chunk(signal), catalogue).drop("chunk", "n"))
    (
        ordered(joined, "split", "activity")
        .write.partitionBy("split", "activity").parquet(path)
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
