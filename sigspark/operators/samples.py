"""Row-wise work on samples: rates, peaks, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.text import decode_peak


def to_samples(signal: DataFrame, sf_ecg: float) -> DataFrame:
    """``(recording_id, idx, t, v, peak)`` with ``t`` from the position."""
    return signal.select(
        "recording_id", "idx",
        ((F.col("idx") - 1) * (1.0 / sf_ecg)).alias("t"), "v",
        F.col("peak").cast("int").alias("peak"),
    )


def downsample(signal: DataFrame, q: int) -> DataFrame:
    """Every q-th sample, starting with the first, re-indexed. No smoothing before it."""
    return signal.where(F.pmod(F.col("idx") - 1, F.lit(q)) == 0).withColumn(
        "idx", F.expr(f"(idx - 1) div {q} + 1")
    )


def peaks_only(signal: DataFrame, codes=(1, 2, 3, 4, 5)) -> DataFrame:
    return signal.where(F.col("peak").isin(*codes))


def with_peak_name(signal: DataFrame) -> DataFrame:
    return signal.withColumn("wave", decode_peak(F.col("peak")))


def as_text(signal: DataFrame, columns=("t", "v", "peak")) -> DataFrame:
    return signal.withColumns({c: F.col(c).cast("string") for c in columns})


def from_text(signal: DataFrame, types=None) -> DataFrame:
    """Parse text columns back; what is no number becomes NULL."""
    types = types or {"t": "double", "v": "double", "peak": "int"}
    return signal.withColumns({c: F.col(c).try_cast(kind) for c, kind in types.items()})


