"""Phase-randomised copies of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.draws import mirrored_phase
from sigspark.operators.chunks import CHUNK, lengths
from sigspark.operators.spectral import GROUP_ROWS, dft_fast, idft, survey_lengths


def surrogate(signal: DataFrame, seed: int, size: int = CHUNK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Same amplitude spectrum, and so the same mean and spread, per recording; drawn phases.

    The constant bin keeps its sign and carries the mean; the spread follows from the other
    amplitudes, which do not change, so the series needs no pass to be rescaled. A flat
    recording has no spread and gives NULL. The lengths are looked up by a job.
    """
    kinds = survey_lengths(lengths(signal), group_rows)
    spectrum = dft_fast(signal, size=size, group_rows=group_rows, kinds=kinds, flat_as_nan=True)
    amplitude, constant = F.hypot("re", "im"), F.col("k") == 0
    angle = mirrored_phase(seed, "recording_id", F.col("k"), F.col("n"))
    turned = spectrum.select(
        "recording_id", "n", "k",
        F.when(constant, F.col("re")).otherwise(amplitude * F.cos(angle)).alias("re"),
        F.when(constant, 0.0).otherwise(amplitude * F.sin(angle)).alias("im"),
    )
    return idft(turned, group_rows, kinds).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
