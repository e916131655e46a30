"""Aggregates per recording. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(signal: DataFrame, value: str = "v") -> DataFrame:
    """Mean and sample standard deviation; the latter is NULL for a single row."""
    return signal.groupBy("recording_id").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def extent(signal: DataFrame, value: str = "v") -> DataFrame:
    return (
        signal.groupBy("recording_id")
        .agg(F.min(value).alias("v_min"), F.max(value).alias("v_max"))
        .withColumn("v_range", F.col("v_max") - F.col("v_min"))
    )


def row_counts(signal: DataFrame) -> DataFrame:
    return signal.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_rows"))


def corpus_tally(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("split", "activity", "label").agg(F.count(F.lit(1)).alias("n_recordings"))


def rr_moments(rr: DataFrame) -> DataFrame:
    """Beat intervals in seconds to interval and rate figures per recording."""
    return (
        rr.where(F.col("rr").isNotNull()).groupBy("recording_id")
        .agg(F.count("rr").alias("n_rr"), F.avg("rr").alias("rr_mean"), F.stddev_samp("rr").alias("rr_sd"))
        .withColumn("hr_mean", F.try_divide(F.lit(60.0), F.col("rr_mean")))
        .withColumn("hr_sd", F.try_divide(60.0 * F.col("rr_sd"), F.col("rr_mean") * F.col("rr_mean")))
    )
