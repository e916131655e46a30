"""Replay of recordings as a stream of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sigspark.sources.scratch import scratch_path


def replay_source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, or one file, as a stream, some files at a time, oldest first."""
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern of this one path: a bare one must be a folder
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern).parquet(path)
    )


def figures(rows: DataFrame, length: str) -> DataFrame:
    """Count and extremes per recording and time window of ``(recording_id, ts, v)``."""
    return (
        rows.groupBy("recording_id", F.window("ts", length).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
        .select("recording_id", F.col("window.start").alias("start"), "n", "v_min", "v_max")
    )


def windowed(stream: DataFrame, length: str, delay: str) -> DataFrame:
    """The same figures of an endless stream.

    The watermark bounds the state: a window is closed once the stream is ``delay`` past it,
    and rows that come later than that are not counted.
    """
    return figures(stream.withWatermark("ts", delay), length)


def replay_windows(stream: DataFrame, length: str = "1 second", path: str | None = None) -> DataFrame:
    """Run the stream over all that is there now and return every window's figures.

    Counts and extremes merge, so each micro-batch writes the figures of its own rows under
    the batch number (a batch that is run again replaces them) and a window's figures are put
    together at the end. There is no state and no watermark: rows count in whatever order
    they arrive.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "replay")

    def save(batch: DataFrame, number: int) -> None:
        figures(batch, length).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        .foreachBatch(save).start()
    )
    query.awaitTermination()
    kinds = figures(spark.createDataFrame([], stream.schema), length).schema
    return spark.read.schema(kinds).parquet(f"{path}/parts").groupBy("recording_id", "start").agg(
        F.sum("n").alias("n"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max")
    )


def follow(stream: DataFrame, path: str, length: str = "1 second", available_now: bool = False) -> StreamingQuery:
    """Run an endless stream ``(recording_id, ts, v)``; stopped and started again, it goes on where it was.

    As in :func:`replay_windows` every micro-batch leaves the figures of its own rows under its
    number, with the last time of each, so there is no state and no row is ever dropped. Read
    them with :func:`followed` at any time.
    """
    def save(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("recording_id", F.window("ts", length).start.alias("start")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.max("ts").alias("last_ts")
        )
        rows.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def followed(spark: SparkSession, path: str, length: str = "1 second", delay: str = "0 seconds") -> DataFrame:
    """``(recording_id, start, n, v_min, v_max, n_late, closed)`` of every window of :func:`follow` so far.

    A window is closed once the stream is ``delay`` past its end. Rows that come after that still
    count: ``n`` and the extremes have them, ``n_late`` says how many they are, so a window that was
    handed on can be replaced. Times are told from the batches in their order, one row for each.
    """
    parts = spark.read.parquet(f"{path}/parts")
    earlier = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    clock = parts.groupBy("batch").agg(F.max("last_ts").alias("seen")).select(
        "batch", F.max("seen").over(earlier).alias("before"), F.max("seen").over(every).alias("now")
    )
    past = F.col("start") + F.expr(f"INTERVAL {length}") + F.expr(f"INTERVAL {delay}")
    late = F.coalesce(past <= F.col("before"), F.lit(False))
    return parts.join(clock, "batch").groupBy("recording_id", "start").agg(
        F.sum("n").alias("n"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("n_late"), F.max(past <= F.col("now")).alias("closed"),
    )
