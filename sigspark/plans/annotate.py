"""From state vectors to scaled, marked, noisy samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.draws import unit_draw
from sigspark.functions.shapes import add_noise, phase, rate_adjust_waves
from sigspark.operators.chunks import CHUNK, attach, own_rows, unkeyed, with_halo
from sigspark.operators.samples import downsample, to_samples
from sigspark.operators.windows import (
    SNAP_DIVISOR, crossing_columns, scale_extent, scaled, snap_columns, snap_width,
)
from sigspark.schema import WAVES


def annotate_each(state: DataFrame, params: DataFrame, seed: int, size: int = CHUNK) -> DataFrame:
    """:func:`annotate` with every recording's own parameters.

    ``params`` has one row per recording with ``recording_id``, ``q``, ``sf_ecg``, ``noise_amp``,
    ``hr_mean`` and ``waves``; the wave angles are adjusted to the heart rate. A recording without
    parameters keeps all its samples, with peak 0 and neither time nor value. ``q`` and the reach
    of the snap are joined before the exchange, so that a sample is copied to the neighbouring
    chunk only if its own recording's rate takes it there; the other parameters come in with the
    extents, on the exchange that the windows use. One small aggregate over ``params`` tells the
    widest reach, for which neighbours are fetched.
    """
    widest = params.agg(F.max(F.expr(f"sf_ecg div {SNAP_DIVISOR}")).alias("d")).first().d or 0
    angles = F.transform(rate_adjust_waves(F.col("waves"), F.col("hr_mean")), lambda w: w["theta"])
    own = params.select(
        F.col("recording_id").alias("_id"), F.col("q").cast("bigint").alias("_q"), F.col("sf_ecg").cast("bigint").alias("_sf"),
        F.col("noise_amp").alias("_noise"), angles.alias("_angles"),
    )
    step = own.select("_id", "_q", F.expr(f"greatest(_sf div {SNAP_DIVISOR}, 0L)").alias("_width"))
    sampled = (
        state.join(step, state["recording_id"].eqNullSafe(step["_id"]), "left").withColumn("_q", F.coalesce("_q", F.lit(1)))
        .where(F.pmod(F.col("idx") - 1, F.col("_q")) == 0)
        .select("recording_id", F.expr("(idx - 1) div _q + 1").alias("idx"), phase(F.col("x"), F.col("y")).alias("theta"), "v", "_width")
    )
    extents = scale_extent(sampled)
    extents = extents.join(own, extents["recording_id"].eqNullSafe(own["_id"]), "left").drop("_id", "_q")
    wide = sampled.withColumn("_halo", F.coalesce(2 * F.col("_width") + 1, F.lit(0)))
    df = attach(with_halo(wide, "_halo", "_halo", size), extents, size)
    df = crossing_columns(df, [F.col("_angles")[k] for k in range(len(WAVES))]).withColumnRenamed("mark", "peak")
    if widest > 0:
        df = snap_columns(df, widest, width=F.col("_width"))
    df = unkeyed(own_rows(df, size))
    noisy = add_noise(scaled("v"), F.col("_noise"), unit_draw(seed, "recording_id", "idx"))
    return df.select(
        "recording_id", "idx", ((F.col("idx") - 1) / F.col("_sf")).alias("t"), noisy.alias("v"), F.col("peak").cast("int").alias("peak")
    )


def annotate(
    state: DataFrame, waves: list, q: int, sf_ecg: int, noise_amp: float, seed: int, size: int = CHUNK
) -> DataFrame:
    """Downsample, mark, snap, scale and add noise to ``(recording_id, idx, x, y, v)``.

    All window steps run on one partitioning and order, which the join with the extents
    shares: the halo covers the crossing and both reaches of the snap, so the samples are
    shuffled and sorted once.
    """
    d = snap_width(sf_ecg)
    sampled = downsample(state, q).select("recording_id", "idx", phase(F.col("x"), F.col("y")).alias("theta"), "v")
    df = with_halo(sampled, 2 * d + 1, 2 * d + 1, size)
    df = crossing_columns(df, waves).withColumnRenamed("mark", "peak")
    if d > 0:
        df = snap_columns(df, d)
    df = unkeyed(attach(own_rows(df, size), scale_extent(sampled), size))
    noisy = add_noise(scaled("v"), noise_amp, unit_draw(seed, "recording_id", "idx"))
    return to_samples(df.withColumn("v", noisy), sf_ecg)
