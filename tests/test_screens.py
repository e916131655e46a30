"""Signals stored for looking at: only the screen's files are read, levels agree with the samples."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from sigspark.operators import windows
from sigspark.sources import screens

SCHEMA = "recording_id string, idx bigint, t double, v double"


@pytest.fixture(scope="module")
def sig(spark):
    lengths = {"long": 4000, "b": 40, "c": 1, None: 60}
    rows = [(name, i, i * 0.25, math.sin(i * i)) for name, n in lengths.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).persist()


@pytest.fixture(scope="module")
def path(spark, sig, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "table")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        screens.write_clustered(sig, path)
    finally:
        spark.conf.unset(merging)
    return path


def rows_of(df):
    return sorted((r.idx, r.t, r.v, r.x) for r in df.collect())


@pytest.mark.parametrize("name, start, width", [("long", 1500, 30), ("long", 1, 5), ("long", 3990, 1000), ("b", 7, 3), ("c", 1, 10), (None, 20, 12)])
def test_screen_is_the_viewport(spark, sig, path, name, start, width):
    whole = windows.viewport(sig.where(F.col("recording_id").eqNullSafe(F.lit(name))), start, width, 0.75)
    found = screens.screen(spark, path, name, start, width, 0.75)
    assert rows_of(found) == rows_of(whole) and found.count() > 0


def test_screen_reads_its_own_files_only(spark, path):
    every = spark.read.parquet(f"{path}/samples").inputFiles()
    found = screens.screen(spark, path, "long", 1500, 30, 0.75)
    assert len(every) >= 6 and 1 <= len(found.inputFiles()) <= 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"idx#\d+L <= \d+", plan) and re.search(r"idx#\d+L >= 1500", plan)


@pytest.mark.parametrize("name, start", [("long", 4001), ("nobody", 1), ("c", 0)])
def test_screens_of_nothing(spark, path, name, start):
    found = screens.screen(spark, path, name, start, 10, 0.75)
    assert found.columns == ["recording_id", "idx", "t", "v", "x"] and found.count() == 0


def test_levels_agree_with_the_samples(spark, sig, tmp_path):
    path = str(tmp_path / "pyramid")
    screens.write_pyramid(sig, path, 0.5, factor=3, levels=3)
    for level in range(3):
        want = windows.decimate(sig, 0.5 * 3**level)
        got = screens.read_level(spark, path, level)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
