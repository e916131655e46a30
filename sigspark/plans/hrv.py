"""Beat statistics and variability bands per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators.chunks import CHUNK
from sigspark.operators.spectral import band_power, dft_fast
from sigspark.operators.stats import rr_moments
from sigspark.operators.windows import rr_intervals
from sigspark.sources.scratch import scratch_root


def hrv_features(signal: DataFrame, bands: dict[str, tuple[float, float]], size: int = CHUNK) -> DataFrame:
    """One row per recording: interval and rate moments, band powers and their ratio.

    Bands are in cycles per beat and get every bin of the beat series up to half a cycle. The
    intervals are a small part of the samples but are read three times, so they are
    checkpointed (a job); the three parts are one row per recording. A recording without a
    beat has counts only.
    """
    scratch_root(signal.sparkSession)
    rr = rr_intervals(signal, size).select("recording_id", "beat", "rr").checkpoint()
    series = rr.where(F.col("rr").isNotNull()).select(
        "recording_id", (F.col("beat") - 1).alias("idx"), F.col("rr").alias("v")
    )
    counts = signal.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_samples"))
    bands_of = band_power(dft_fast(series, size=size), bands, 1.0)
    for part in (rr_moments(rr), bands_of):
        part = part.withColumnRenamed("recording_id", "_id")
        counts = counts.join(part, counts["recording_id"].eqNullSafe(part["_id"]), "left").drop("_id")
    return counts
