"""Lookups and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.chunks import explode_range, keyed, unkeyed
from sigspark.operators.index import PIECE_ROWS, cut_keys, hot_keys


def widen_ranges(ranges: DataFrame, params: list[str]) -> DataFrame:
    """Long ranges ``(activity, param, lo, hi)`` to one row per activity."""
    picks = []
    for p in params:
        is_p = F.col("param") == p
        picks += [F.max(F.when(is_p, F.col("lo"))).alias(f"{p}_lo"), F.max(F.when(is_p, F.col("hi"))).alias(f"{p}_hi")]
    return ranges.groupBy("activity").agg(*picks)


def lookup_ranges(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges of each row's activity, NULL where unknown.

    No hint: Spark broadcasts the range table when its measured size is below the
    broadcast threshold, and otherwise splits the skewed activities at run time.
    """
    return plan.join(ranges, "activity", "left")


def expand_plan(scenarios: DataFrame) -> DataFrame:
    """One row per sample of each scenario ``(folder, activity, samples, ...)``, numbered from 0."""
    numbered = scenarios.withColumns({
        "_first": F.lit(0).cast("bigint"), "_last": F.col("samples").cast("bigint") - 1,
    })
    return (
        explode_range(numbered, "_first", "_last", "_no", spread_by=["folder", "activity"])
        .withColumn("sample_no", F.col("_no").cast("int"))
        .drop("_first", "_last", "_no")
    )


def hold_on_grid(signal: DataFrame, rr: DataFrame, sf: int) -> DataFrame:
    """Interval in force at each sample, for an interval series on a regular grid of ``sf``.

    The grid position is part of the join key, so a hot recording spreads by itself.
    """
    steps = rr.select("recording_id", F.col("idx").alias("_step"), "rr")
    return (
        signal.withColumn("_step", F.floor(F.col("t") * sf).cast("bigint") + 1)
        .join(steps, ["recording_id", "_step"], "left")
        .drop("_step")
    )


def hold_asof(points: DataFrame, steps: DataFrame, piece_rows: float = PIECE_ROWS) -> DataFrame:
    """Last step value at or before each point, for irregular times.

    ``points`` has ``(recording_id, t, ...)``, ``steps`` has ``(recording_id, t, rr)``. Both go through
    one window per recording. A recording with more than ``piece_rows`` points and steps is cut
    at common quantiles of their times (:func:`cut_keys`), so a burst is as many pieces as it has
    rows for, however short it is; the last step of each piece is carried into the later ones.
    Only rows of one instant stay together. Steps without a time hold nothing; points without
    one, and points before the first step, get NULL.
    """
    marked = keyed(points.withColumn("_is_point", F.lit(1)).unionByName(
        steps.where(F.col("t").isNotNull()).select("recording_id", "t", F.struct("rr").alias("_held")).withColumn("_is_point", F.lit(0)),
        allowMissingColumns=True,
    ))
    # Points without a time come before all others.
    order = [F.col("t").asc_nulls_first(), F.col("_is_point")]
    if hot_keys(marked, ["recording_id"], piece_rows) is None:
        so_far = Window.partitionBy("recording_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        held = marked.withColumn("_now", F.last("_held", ignorenulls=True).over(so_far)).where(F.col("_is_point") == 1)
        return unkeyed(held).select(*points.columns, F.col("_now")["rr"].alias("rr"))
    cut, pieces = cut_keys(marked, ["recording_id"], ["t"], piece_rows)
    key = ["recording_id", *pieces]
    earlier = Window.partitionBy("recording_id").orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.where("_cut").groupBy(*key).agg(F.max_by("_held", F.when(F.col("_is_point") == 0, F.col("t"))).alias("_last")).select(
        *key, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = cut.withColumn("_now", F.last("_held", ignorenulls=True).over(so_far)).where(F.col("_is_point") == 1)
    return unkeyed(held.join(carry, key, "left")).select(*points.columns, F.coalesce("_now", "_carried")["rr"].alias("rr"))


def expand_beats(beats: DataFrame) -> DataFrame:
    """One row per sample of each beat ``(recording_id, beat, start_idx, end_idx, rr)``."""
    return explode_range(beats, "start_idx", "end_idx", "idx").select(
        "recording_id", "idx", "beat", "rr"
    )
