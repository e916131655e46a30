"""Column functions, parameter checks, plans, files and logs."""

from __future__ import annotations

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from sigspark import schema
from sigspark.functions import draws, shapes, text
from sigspark.functions.clock import instant_text
from sigspark.operators import joins, samples, validate
from sigspark.plans import dataset
from sigspark.registry import QUERIES
from sigspark.sources import catalog, runlog, signals


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_axis_text(spark):
    df = spark.createDataFrame([(0.0,), (0.125,), (12345.678,), (0.001,)], "x double")
    two = [r[0] for r in df.select(text.format_axis(F.col("x"), 100.0, 0.01, 2)).collect()]
    assert two == ["0.00", "0.12", "1.23E4", "1.00E-3"]
    three = [r[0] for r in df.select(text.format_axis(F.col("x"), 100.0, 0.01, 3)).collect()]
    assert three == ["0.0", "0.1", "1.2E4", "1.0E-3"]


def test_angles(spark):
    row = one(
        spark, a=shapes.wrap_angle(F.lit(3 * math.pi / 2)), b=shapes.wrap_angle(F.lit(math.pi)),
        c=shapes.adjust_angle(F.lit("P"), F.lit(1.0), F.lit(240.0)), d=shapes.adjust_angle(F.lit("Q"), F.lit(1.0), F.lit(240.0)),
        e=shapes.adjust_angle(F.lit("R"), F.lit(1.0), F.lit(240.0)),
    )
    assert row.a == pytest.approx(-math.pi / 2) and row.b == pytest.approx(math.pi)
    assert (row.c, row.d, row.e) == (pytest.approx(math.sqrt(2)), 2.0, 1.0)


def test_pow2_and_zoom(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 1023, 1024, 1025, 2 ** 40 + 1)], "n bigint")
    got = [r[0] for r in df.select(shapes.next_pow2(F.col("n"))).collect()]
    assert got == [1, 2, 4, 4, 8, 1024, 1024, 2048, 2 ** 41]
    assert shapes.zoomed(0.008, 1) == 0.004 and shapes.zoomed(0.008, -2) == 0.032


def test_draws(spark):
    df = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    u = df.select(
        draws.uniform(2.0, 3.0, 1, "k").alias("u"), draws.uniform_int(1, 42, 1, "k").alias("i")
    ).agg(F.min("u"), F.max("u"), F.avg("u"), F.min("i"), F.max("i")).first()
    assert 2.0 <= u[0] and u[1] < 3.0 and u[2] == pytest.approx(2.5, abs=0.01) and (u[3], u[4]) == (1, 42)
    again = df.repartition(7).select(draws.unit_draw(1, "k").alias("u")).agg(F.sum(F.round("u", 6))).first()[0]
    assert again == pytest.approx(df.select(draws.unit_draw(1, "k").alias("u")).agg(F.sum(F.round("u", 6))).first()[0])


def test_names(spark):
    micros = [1767225600123456, 1767225600000000, 1767225600120000]
    df = spark.createDataFrame([(m,) for m in micros], "m bigint")
    names = [r[0] for r in df.select(text.recording_name(instant_text(F.col("m")), F.lit(3), F.lit("Working Overlap"), F.lit(79))).collect()]
    assert names == [
        "2026-01-01T00_00_00_123456Z_3_Working-Overlap_0079", "2026-01-01T00_00_00Z_3_Working-Overlap_0079",
        "2026-01-01T00_00_00_120Z_3_Working-Overlap_0079",
    ]


def test_relabel(spark):
    names = spark.createDataFrame([
        ("2026-01-01T00_00_00_123456Z_1_Resting-Normal_0001.csv",), ("2026-01-01T00_00_00Z_3_Working-Overlap_0079.csv",),
        ("2026-01-01_1_Resting-Normal.csv",), ("notes.csv",),
    ], "file_name string")
    out = catalog.relabel(catalog.catalog_of(names), catalog.relabel_rules(spark))
    renamed = {r.old_name: r.new_name for r in out.collect()}
    assert renamed == {
        "2026-01-01T00_00_00_123456Z_1_Resting-Normal_0001.csv": "2026-01-01T00_00_00_123456Z_0_Resting-Normal_0001.csv",
        "2026-01-01T00_00_00Z_3_Working-Overlap_0079.csv": "2026-01-01T00_00_00Z_3_Working-Overlap_0079.csv",
        "2026-01-01_1_Resting-Normal.csv": "2026-01-01_0_Resting-Normal.csv",
    }


# --- checks -----------------------------------------------------------------------

def raw_row(spark, **changed):
    good = {c: "1.0" for c in validate.raw_columns()} | {"n_beats": "256", "sf_ecg": "256", "sf": "512", "seed": "1"}
    return validate.validate_params(spark.createDataFrame([good | changed])).first()


def test_field_errors_come_in_field_order(spark):
    assert len(validate.raw_columns()) == 28
    assert raw_row(spark).valid
    assert raw_row(spark, hr_mean="x", n_beats="1.5").errors == [
        "Incorrect 'Approximate number of heart beats' entered, please correct it!",
        "Incorrect 'Heart rate mean' entered, please correct it!",
    ]
    assert raw_row(spark, n_beats=" 5").errors and raw_row(spark, seed="99999999999").errors
    assert raw_row(spark, hr_std="NaN").errors and not raw_row(spark, hr_std=" 1e3 ").errors


def test_rate_rules(spark):
    rates = [raw_row(spark, sf=sf, sf_ecg=ecg) for sf, ecg in (("512", "256"), ("500", "256"), ("512", "0"))]
    assert [r.valid for r in rates] == [True, False, False]
    assert rates[1].errors == [validate.RATE_MESSAGE, validate.RULES_MESSAGE]
    # A wrong output rate hides the internal one; the defaults then pass the last rule.
    assert raw_row(spark, sf_ecg="x", sf="y").errors == ["Incorrect 'ECG Sampling Frequency' entered, please correct it!"]


def test_unknown_activity_is_gated_out(spark):
    params = spark.createDataFrame([("Exercising",), ("Working-Normal",), (None,)], "activity string")
    wide = joins.widen_ranges(schema.activity_ranges(spark), ["hr_mean"])
    good, bad = validate.gate(validate.flag_unknown(params, wide))
    assert [r.activity for r in good.collect()] == ["Working-Normal"]
    assert {(r.reason, r.hr_mean_lo) for r in bad.collect()} == {("unknown activity: Exercising", None), ("unknown activity: (none)", None)}


# --- plans ------------------------------------------------------------------------

def test_plan_of_the_fixed_scenarios(spark):
    args = (schema.scenarios(spark), schema.activity_ranges(spark), 1, 1_767_225_600_000_000)
    plan = dataset.plan_dataset(*args).persist()
    assert plan.count() == 1200 and plan.where("valid").count() == 1200
    assert plan.select("recording_id").distinct().count() == 1200
    waves = plan.select(F.col("waves")[2].alias("r"), "a_r", "b_r").where("r.wave <> 'R' OR r.a <> a_r OR r.b <> b_r")
    assert waves.count() == 0 and runlog.pivot_log(runlog.param_lines(plan)).count() == 1200
    per = {r[0]: r[1:] for r in plan.groupBy("split").agg(F.count("*"), F.min("noise_amp"), F.max("noise_amp")).collect()}
    assert per["Env1"][0] == 200 and per["Eval"][0] == 400 and 0.06 <= per["Env1"][1] and per["Env1"][2] < 0.12
    joined = plan.join(joins.widen_ranges(schema.activity_ranges(spark), list(schema.RANGE_PARAMS)), "activity")
    outside = " or ".join(f"{p} < {p}_lo or {p} >= {p}_hi" for p in schema.RANGE_PARAMS)
    assert joined.where(outside).count() == 0
    assert plan.where("seed between 1 and 42 and a_r between 27 and 44 and b_r >= 0.08 and b_r < 0.12").count() == 1200
    old = dataset.plan_dataset(*args, compat=True)
    assert old.where("seed between 27 and 44 and a_r >= 0.08 and a_r < 0.12 and b_r = 0.1").count() == 1200


def test_plan_with_bad_rates_or_activity_is_marked(spark):
    one_scenario = schema.values_table(spark, "folder, activity, label, samples, noise_min, noise_max", [("E", "Exercising", 0, 2, 0.1, 0.2)])
    plan = dataset.plan_dataset(one_scenario, schema.activity_ranges(spark), 1, 0)
    assert {r.reason for r in plan.collect()} == {"unknown activity: Exercising"}
    plan = dataset.plan_dataset(schema.scenarios(spark), schema.activity_ranges(spark), 1, 0, sf=500)
    assert plan.where("valid").count() == 0


def test_waves_there_and_back(spark):
    params = dataset.with_defaults(spark.range(3).withColumnRenamed("id", "k")).select("k", "waves")
    rows = dataset.explode_waves(params)
    assert rows.count() == 15
    back = dataset.implode_waves(rows, ["k"])
    assert back.exceptAll(params).count() == 0 and back.schema["waves"].dataType.simpleString() == schema.WAVE_TYPE


def test_downsample(spark):
    df = spark.createDataFrame([("x", i, float(i)) for i in range(1, 6)], "recording_id string, idx bigint, v double")
    assert [(r.idx, r.v) for r in samples.downsample(df, 2).collect()] == [(1, 1.0), (2, 3.0), (3, 5.0)]


def test_text_that_is_no_number_becomes_null(spark):
    df = spark.createDataFrame([("1.5", "x", "3")], "t string, v string, peak string")
    assert tuple(samples.from_text(df).first()) == (1.5, None, 3)


# --- files -------------------------------------------------------------------------

def test_read_recording_files(spark, tmp_path):
    stem = "2026-01-01T00_00_00Z_0_Resting-Normal_0001"
    (tmp_path / f"{stem}.csv").write_bytes(b"Time,Voltage,Peak\r\n0.0,-0.39,0\r\n0.00390625,1.2,3\r\n")
    (tmp_path / "notes.txt").write_text("no recording")
    for rate in (256, None):
        rows = signals.read_signals(spark, str(tmp_path), sf_ecg=rate).orderBy("idx").collect()
        assert [tuple(r) for r in rows] == [(stem, 1, 0.0, -0.39, 0), (stem, 2, 0.00390625, 1.2, 3)]
    found = catalog.recording_catalog(spark, str(tmp_path)).first()
    assert (found.recording_id, found.ts, found.label, found.activity, found.sample_no) == (
        stem, "2026-01-01T00_00_00Z", 0, "Resting-Normal", 1)


def test_malformed_file_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Time,Voltage,Peak\r\n0.0,high,0\r\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        signals.read_signals(spark, str(tmp_path), sf_ecg=256).collect()


@pytest.mark.parametrize("layout", ["folders", "table"])
@pytest.mark.parametrize("choice", ["comma", "tab", ";x"])
def test_write_and_read_back(spark, tmp_path, layout, choice):
    df = spark.createDataFrame(
        [(rec, i, (i - 1) / 256.0, i * 0.1, i % 6) for rec in ("a", "b") for i in range(1, 9)], schema.SIGNAL
    )
    sep = signals.separator(choice)
    path = str(tmp_path / "out")
    signals.write_signals(df, path, sep, layout)
    first = next(os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.endswith(".csv"))
    head = open(first, "rb").read().split(b"\r\n")[0].decode()
    assert head == sep.join((["recording_id"] if layout == "table" else []) + ["Time", "Voltage", "Peak"])
    back = signals.read_signals(spark, path, sep, sf_ecg=256, layout=layout)
    assert back.exceptAll(df).count() == 0 and back.count() == 16


def test_corpus(spark, tmp_path):
    df = spark.createDataFrame([(rec, i, 0.0, 1.0, 0) for rec in ("a", "b") for i in range(1, 9)], schema.SIGNAL)
    recs = spark.createDataFrame([("a", "Env1", "X", 0), ("b", "Env2", "Y", 1)], "recording_id string, split string, activity string, label int")
    path = str(tmp_path / "corpus")
    signals.write_corpus(df, recs, path)
    assert sorted(os.listdir(path))[-2:] == ["split=Env1", "split=Env2"]
    assert signals.read_corpus(spark, path).where("split = 'Env2' and activity = 'Y' and label = 1").count() == 8


def params(spark):
    base = dataset.with_defaults(spark.createDataFrame([("r1",), ("r2",)], "recording_id string"))
    return base.withColumn("hr_mean", F.lit(61.5))


def test_run_log_there_and_back(spark, tmp_path):
    path = str(tmp_path / "logs")
    runlog.write_run_log(params(spark), path, layout="folders")
    back = runlog.read_run_log(spark, path).drop("series_n")
    want = params(spark).select(*back.columns)
    assert back.exceptAll(want).count() == 0 and back.count() == 2


def test_log_with_clock_prefix_and_no_header(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(
        b"[10:15:00 AM]: Heart rate mean: 60.0 beats per minute\r\n[10:15:00 AM]: ECG sampling frequency: 256 Hertz\n"
        b"[10:15:00 AM]:       theta(radians)\n[10:15:00 AM]: P: [-1.5\t]\n[10:15:00 AM]:       a(calculated)\n[10:15:00 AM]: P: [1.2\t]\n"
    )
    row = runlog.read_run_log(spark, str(tmp_path)).first()
    assert (row.recording_id, row.hr_mean, row.sf_ecg, row.n_beats) == ("x", 60.0, 256, None)
    assert (row.waves[0].theta, row.waves[0].a, row.waves[0].b, row.waves[1].theta) == (-1.5, 1.2, None, None)


def test_form_layout_of_a_log(spark):
    text = ["ECG Parameters:", "Heart rate mean: 60.0 beats per minute", "Order of Extrema:", "      theta", "P: [1] = -60.0", "T: [5] = 90.0",
            "      a", "P: [1] = 1.2", "      b", "P: [1] = 0.25", "Using 131072 = 2^ 17 samples for calculating RR intervals"]
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(text)], "recording_id string, line_no int, line string")
    row = runlog.pivot_log(lines).first()
    assert (row.hr_mean, row.series_n, row.waves[0].a, row.waves[0].b, row.waves[4].a) == (60.0, 131072, 1.2, 0.25, None)
    assert abs(row.waves[0].theta + 1.0471975511965976) < 1e-12 and abs(row.waves[4].theta - 1.5707963267948966) < 1e-12


def test_the_log_queries_run_in_methods_that_the_jvm_compiles(spark, tmp_path, capsys):
    """HotSpot leaves methods of more than 8,000 bytes of code to the interpreter."""
    spark.range(3).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the query runs
    try:
        for name in ("a7_log_pivot", "a7_form_layout"):
            capsys.readouterr()
            QUERIES[name](spark, str(tmp_path)).explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 6000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_odd_log_lines(spark):
    """Clock prefixes, a label or a wave without a number, parameters out of place, brackets in labels."""
    text = ["[1:00]: [2:00]: Heart rate std: 9.0", "[1:00]: Heart rate std: 2.5 beats per minute", "Heart rate mean:  7", "Heart rate mean: ", "High frequency: 0.25",
            "[x Low frequency: 3.0", "a: Low frequency: 3.0", "[1:00]: Using 1024 = 2^ 10 samples", "[1:00]:  b:", "[1:00]: S: [4] = 0.5", "S: [", "Q: [1 2\t]", "X: [1.0\t]"]
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(text)], "recording_id string, line_no int, line string")
    row = runlog.pivot_log(lines).first()
    assert (row.hr_std, row.hr_mean, row.f_hi, row.f_lo, row.series_n) == (2.5, None, 0.25, None, 1024)
    assert [w.b for w in row.waves] == [None, None, None, 0.5, None]


def test_a_catalogue_that_names_a_recording_twice_is_refused(spark, tmp_path):
    one = spark.createDataFrame([("x", 1, 0.0, 1.0, 0)], "recording_id string, idx bigint, t double, v double, peak int")
    twice = spark.createDataFrame([("x", "Env1", "a"), ("x", "Eval", "a")], "recording_id string, split string, activity string")
    with pytest.raises(ValueError, match="more than once"):
        signals.write_corpus(one, twice, str(tmp_path / "corpus"))


def test_a_log_is_read_once_without_a_table_of_all_recordings(spark):
    """Copies, another order of the sections, no name: all from one exchange, with nothing broadcast or joined."""
    text = ["LF/HF ratio: 0.5", "a(calculated)", "P: [1.5\t]", "Q: [x\t]", "theta(radians)", "P: [-0.5\t]", "b(calculated)", "P: [7.0\t]", "LF/HF ratio: 0.25"]
    rows = [(name, i, t) for name in ("x", None) for i, t in enumerate(text)]
    lines = spark.createDataFrame([*rows, *rows, ("y", 0, "nothing"), ("z", 0, None)], "recording_id string, line_no int, line string")
    out = runlog.pivot_log(lines)
    got = {r.recording_id: (r.lf_hf_ratio, r.n_beats, [tuple(w) for w in r.waves[:2]]) for r in out.collect()}
    both = (0.5, None, [("P", -0.5, 1.5, 7.0), ("Q", None, None, None)])
    none = (None, None, [("P", None, None, None), ("Q", None, None, None)])
    assert out.count() == 4 and got == {"x": both, None: both, "y": none, "z": none}
    plan = runlog.pivot_log(runlog.param_lines(params(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange ") == 1


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """More folders than listing tasks: a task per folder would make the listing the longest step."""
    df = spark.createDataFrame([(f"r{k}", 1, 0.0, 1.0, 0) for k in range(80)], schema.SIGNAL)
    path = str(tmp_path / "out")
    signals.write_signals(df, path, layout="folders")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    back = signals.read_signals(spark, path, sf_ecg=256, layout="folders")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= signals.LISTINGS * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before and back.count() == 80 and back.exceptAll(df).count() == 0
