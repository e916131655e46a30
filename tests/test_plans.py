"""The physical plans keep to the cutting: no window or sort over a whole recording."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sigspark.operators import spectral, windows
from sigspark.operators.index import with_index
from sigspark.plans.annotate import annotate, annotate_each
from sigspark.registry import QUERIES
from sigspark.schema import default_waves


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "signal")
    spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("recording_id"), (F.floor(F.col("id") / 3) + 1).alias("idx"),
        F.col("id").cast("double").alias("t"), F.sin("id").alias("v"), (F.col("id") % 6).cast("int").alias("peak"),
        F.cos("id").alias("x"), F.sin("id").alias("y"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_recording_only(plan: str) -> list[str]:
    """Window steps partitioned by the recording alone."""
    return [line for line in plan.splitlines() if re.search(r"Window.*, \[recording_id#\w+\]", line)]


def sample_exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(recording_id#\w+, chunk#\w+", plan))


@pytest.mark.parametrize("op", [
    lambda s: windows.segments(s), lambda s: windows.snap_peaks(s, 4), lambda s: windows.minmax_scale(s),
    lambda s: windows.mark_crossings(s.withColumn("theta", F.col("v")), [0.1, 0.2, 0.3, 0.4, 0.5]),
    lambda s: spectral.dft(s, 4), lambda s: annotate(s, [-1.0, -0.3, 0.0, 0.3, 1.5], 2, 256, 0.1, 1),
])
def test_no_window_over_a_whole_recording(stored, op):
    assert by_recording_only(plan_of(op(stored))) == []


def test_annotate_shuffles_the_samples_once(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(annotate(stored, [-1.0, -0.3, 0.0, 0.3, 1.5], 2, 256, 0.1, 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of the samples and one of the small per-chunk extents they join.
    assert sample_exchanges(plan) == 2
    assert "Python" not in plan


def test_annotate_each_shuffles_the_samples_once(spark, stored):
    params = stored.select("recording_id").distinct().select(
        "recording_id", F.lit(2).alias("q"), F.lit(256).alias("sf_ecg"), F.lit(0.1).alias("noise_amp"), F.lit(60.0).alias("hr_mean"), default_waves().alias("waves"))
    plan = plan_of(annotate_each(stored, params, 1))
    assert sample_exchanges(plan) == 2 and by_recording_only(plan) == [] and "Python" not in plan


def test_scan_reads_only_needed_columns(stored):
    plan = plan_of(windows.minmax_scale(stored.select("recording_id", "idx", "v")))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {"recording_id:string,idx:bigint,v:double"}


def test_filters_reach_the_scan(stored):
    plan = plan_of(windows.viewport(stored, 10, 50, 1.0))
    assert plan.count("GreaterThanOrEqual(idx,10)") >= 1


def test_numbering_without_hot_keys_is_one_window(stored):
    """Beside the count that looked for hot keys: one scan, one exchange, no quantile."""
    plan = plan_of(with_index(stored.drop("idx"), ["recording_id"], ["t"])).split("== Initial Plan ==")[-1]
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "percentile" not in plan and "Subquery" not in plan and "Join" not in plan


def test_numbering_with_hot_keys_reads_twice_more(stored):
    """Counts and quantiles are tables by then; the rows are read for the pieces' counts and for the numbers."""
    plan = plan_of(with_index(stored.drop("idx"), ["recording_id"], ["t"], piece_rows=100)).split("== Initial Plan ==")[-1]
    assert plan.count("Scan parquet") == 2 and "percentile" not in plan


def test_aggregates_read_samples_without_numbers(spark):
    for name in ("d1_moments", "d2_extent", "d3_row_counts"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1]
        assert plan.count("Scan parquet") == 1 and "Window" not in plan and plan.count("Exchange") == 1
