"""Signals stored for looking at: any screen of a long recording without reading the rest of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.windows import decimate, viewport
from sigspark.sources.signals import ordered


def write_clustered(signal: DataFrame, path: str) -> None:
    """``samples`` sorted by recording and position, and ``ranges``: which stretch of which recording each file has.

    The ranges have one row per file and recording, themselves sorted by recording, so a long
    recording has as many as it has files and a short one has one or two.
    """
    ordered(signal).write.parquet(f"{path}/samples")
    stored = signal.sparkSession.read.schema(signal.schema).parquet(f"{path}/samples")
    ranges = stored.groupBy("recording_id", F.col("_metadata.file_name").alias("file")).agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    ranges.repartitionByRange("recording_id", "first_idx").sortWithinPartitions("recording_id", "first_idx").write.parquet(f"{path}/ranges")


def screen(spark: SparkSession, path: str, recording_id: str, start: int, width: int, zoom: float) -> DataFrame:
    """:func:`viewport` of one recording, from a clustered table.

    Looks up the files that hold the screen and reads only these, between the first and the last
    position they can show. What reaches the driver are the names of the screen's files. A
    position that the recording does not have shows nothing.
    """
    named = F.col("recording_id").eqNullSafe(F.lit(recording_id))
    ranges = spark.read.parquet(f"{path}/ranges").where(named)
    files = [r.file for r in ranges.where((F.col("first_idx") <= start) & (F.col("last_idx") >= start)).select("file").collect()]
    schema = spark.read.parquet(f"{path}/samples").schema
    read = lambda names: spark.read.schema(schema).parquet(*[f"{path}/samples/{name}" for name in names])
    first = read(files).where(named & (F.col("idx") == start)).select("t").first() if files else None
    if first is None:
        return viewport(spark.createDataFrame([], schema), start, width, zoom)
    end = (first.t // zoom + width + 1) * zoom
    shown = ranges.where((F.col("last_idx") >= start) & (F.col("first_t") <= end)).select("file", "last_idx").collect()
    last = max(r.last_idx for r in shown)
    return viewport(read(sorted(r.file for r in shown)).where(named & F.col("idx").between(start, last)), start, width, zoom)


def write_pyramid(signal: DataFrame, path: str, zoom: float, factor: int = 4, levels: int = 3) -> None:
    """Extremes, first and last value per pixel column at ``zoom``, ``zoom * factor``, ...: a table per level.

    The samples are read for the finest level only; every other is made from the one below. Each
    is sorted by recording and column, so a screen of it is a stretch of few files.
    """
    spark, step = signal.sparkSession, decimate(signal, zoom)
    for level in range(levels):
        step.repartitionByRange("recording_id", "x").sortWithinPartitions("recording_id", "x").write.parquet(f"{path}/level={level}")
        below = spark.read.schema(step.schema).parquet(f"{path}/level={level}")
        step = below.groupBy("recording_id", F.floor(F.col("x") / factor).cast("bigint").alias("x")).agg(
            F.sum("n").alias("n"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"),
            F.min_by("v_first", below["x"]).alias("v_first"), F.max_by("v_last", below["x"]).alias("v_last"),
        )


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """One row per recording and pixel column of a level of :func:`write_pyramid`."""
    return spark.read.parquet(f"{path}/level={level}")
