"""Queries of the sources and sinks (A) and of the streams (I)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigspark import schema
from sigspark.functions import clock, shapes
from sigspark.operators.samples import to_samples
from sigspark.registry.base import query, rounded
from sigspark.registry.ordered import SEGMENTS_SQL
from sigspark.registry.scalars import NAME_SQL, named_events
from sigspark.registry.tables import dbl, signal, stored_signal, table, with_signal
from sigspark.sources import catalog, runlog, signals
from sigspark.sources.scratch import scratch_path
from sigspark.streaming.replay import follow, followed, replay_source, replay_windows
from sigspark.streaming.segments import stream_segments


@query("a1_signal_scan", with_signal("SELECT recording_id, idx, t, v, peak FROM sig"))
def a1_signal_scan(spark, d):
    path = scratch_path(spark, "signals")
    signals.write_signals(signal(spark, d), path, layout="folders")
    return signals.read_signals(spark, path, layout="folders")


@query("a2_delimited_roundtrip", with_signal("SELECT recording_id, idx, (idx - 1) / 256e0 AS t, v, peak FROM sig"))
def a2_delimited_roundtrip(spark, d):
    path = scratch_path(spark, "signals")
    sep = signals.separator("tab")
    signals.write_signals(to_samples(signal(spark, d), 256), path, sep)
    return signals.read_signals(spark, path, sep, sf_ecg=256, layout="table")


@query("a3_partitioned_corpus", with_signal("""
SELECT 'Env' || CAST(CAST(recording_id AS BIGINT) % 4 + 1 AS VARCHAR) AS split,
       CASE CAST(recording_id AS BIGINT) % 3 WHEN 0 THEN 'Resting-Normal' WHEN 1 THEN 'Working-Normal' ELSE 'Working-Overlap' END AS activity,
       count(*) AS n_rows, count(DISTINCT recording_id) AS n_recordings, round(sum(v), 4) AS v_sum
FROM sig GROUP BY ALL"""))
def a3_partitioned_corpus(spark, d):
    sig = stored_signal(spark, d).select("recording_id", "idx", "t", "v", "peak")
    user = F.col("recording_id").cast("bigint")
    recordings = sig.select("recording_id").distinct().select(
        "recording_id", F.concat(F.lit("Env"), (user % 4 + 1).cast("string")).alias("split"),
        F.when(user % 3 == 0, "Resting-Normal").when(user % 3 == 1, "Working-Normal").otherwise("Working-Overlap").alias("activity"),
    )
    path = scratch_path(spark, "corpus")
    signals.write_corpus(sig, recordings, path)
    per_recording = signals.read_corpus(spark, path).groupBy("split", "activity", "recording_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total")
    )
    return per_recording.groupBy("split", "activity").agg(
        F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_recordings"), F.round(F.sum("total"), 4).alias("v_sum")
    )


NAMES_SQL = f"""names AS (
  SELECT event_id, recording_id || '.csv' AS file_name, recording_id,
         regexp_extract(recording_id, '^(.+Z)_(\\d+)_([A-Za-z-]+)_(\\d+)$', 1) AS ts,
         CAST(regexp_extract(recording_id, '^(.+Z)_(\\d+)_([A-Za-z-]+)_(\\d+)$', 2) AS INTEGER) AS label,
         regexp_extract(recording_id, '^(.+Z)_(\\d+)_([A-Za-z-]+)_(\\d+)$', 3) AS activity,
         CAST(regexp_extract(recording_id, '^(.+Z)_(\\d+)_([A-Za-z-]+)_(\\d+)$', 4) AS INTEGER) AS sample_no
  FROM (SELECT event_id, {NAME_SQL} AS recording_id FROM events))"""


def _catalog(spark, d):
    names = named_events(spark, d).select("event_id", F.concat("recording_id", F.lit(".csv")).alias("file_name"))
    return catalog.catalog_of(names)


@query("a4_name_catalog", f"WITH {NAMES_SQL} SELECT * FROM names")
def a4_name_catalog(spark, d):
    return _catalog(spark, d)


@query("a5_relabel", f"""
WITH {NAMES_SQL}
SELECT event_id, file_name AS old_name, CASE WHEN activity = 'Resting-Normal' THEN 0 ELSE label END AS new_label,
       CASE WHEN activity = 'Resting-Normal' THEN ts || '_0_' || activity || '_' || lpad(CAST(sample_no AS VARCHAR), 4, '0') || '.csv'
            ELSE file_name END AS new_name
FROM names""")
def a5_relabel(spark, d):
    return catalog.relabel(_catalog(spark, d), catalog.relabel_rules(spark)).select(
        "event_id", "old_name", "new_label", "new_name"
    )


def _params(spark, d):
    """Customers as parameter rows, with angles in radians as a log has them."""
    k = F.col("c_custkey")
    waves = F.transform(schema.default_waves(), lambda w: w.withField("theta", shapes.deg2rad(w["theta"])))
    return table(spark, d, "customer").select(
        k.cast("string").alias("recording_id"), F.lit(256).alias("n_beats"), F.lit(256).alias("sf_ecg"), F.lit(512).alias("sf"),
        F.round(0.05 + k % 20 / 100.0, 2).alias("noise_amp"), (50 + k % 90).cast("double").alias("hr_mean"),
        F.round(1 + k % 15 / 10.0, 1).alias("hr_std"), F.lit(0.1).alias("f_lo"), F.lit(0.01).alias("f_hi_std"),
        F.lit(0.01).alias("f_lo_std"), F.lit(0.25).alias("f_hi"), F.lit(0.5).alias("lf_hf_ratio"),
        F.lit(3).cast("bigint").alias("period_ms"), waves.alias("waves"),
        shapes.next_pow2(256 * (60 / (50 + k % 90).cast("double")) * 512).alias("series_n"),
    )


PARAMS_SQL = """params AS (
  SELECT CAST(c_custkey AS VARCHAR) AS recording_id, round(0.05e0 + c_custkey % 20 / 100e0, 2) AS noise_amp,
         CAST(50 + c_custkey % 90 AS DOUBLE) AS hr_mean, round(1 + c_custkey % 15 / 10e0, 1) AS hr_std,
         list_min(list_filter(list_transform(range(10, 25), lambda k: CAST(1 AS BIGINT) << k), lambda x: x >= 256 * (60 / CAST(50 + c_custkey % 90 AS DOUBLE)) * 512)) AS series_n
  FROM customer)"""


def _log_sql() -> str:
    lines = [
        "'ECG Log:'", "'Approximate number of heart beats: 256'", "'ECG sampling frequency: 256 Hertz'",
        "'Internal sampling frequency: 512 Hertz'",
        "'Amplitude of additive uniformly distributed noise: ' || CAST(noise_amp AS VARCHAR) || ' mV'",
        "'Heart rate mean: ' || CAST(hr_mean AS VARCHAR) || ' beats per minute'",
        "'Heart rate std: ' || CAST(hr_std AS VARCHAR) || ' beats per minute'",
        "'Low frequency: 0.1 Hertz'", "'High frequency std: 0.01 Hertz'", "'Low frequency std: 0.01 Hertz'",
        "'High frequency: 0.25 Hertz'", "'LF/HF ratio: 0.5'", "'time step milliseconds: 3'", "'Order of Extrema:'",
    ]
    for title, pick in (("theta(radians)", lambda w: math.radians(w[1])), ("a(calculated)", lambda w: w[2]), ("b(calculated)", lambda w: w[3])):
        lines.append(f"'      {title}'")
        lines += [f"'{w[0]}: [{pick(w)!r}' || chr(9) || ']'" for w in schema.DEFAULT_WAVES]
    lines.append("'Using ' || CAST(series_n AS VARCHAR) || ' = 2^ ' || CAST(CAST(round(log2(series_n)) AS INTEGER) AS VARCHAR) || ' samples'")
    return ", ".join(lines)


@query("a6_param_lines", f"""
WITH {PARAMS_SQL}
SELECT recording_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line
FROM (SELECT recording_id, [{_log_sql()}] AS lines FROM params)""")
def a6_param_lines(spark, d):
    return runlog.param_lines(_params(spark, d))


PIVOT_SQL = f"""
WITH {PARAMS_SQL}
SELECT recording_id, 256 AS n_beats, 256 AS sf_ecg, 512 AS sf, noise_amp, hr_mean, hr_std, 0.1e0 AS f_lo, 0.01e0 AS f_hi_std,
       0.01e0 AS f_lo_std, 0.25e0 AS f_hi, 0.5e0 AS lf_hf_ratio, CAST(3 AS BIGINT) AS period_ms, series_n,
       {dbl(math.radians(-60.0))} AS theta_p, 30e0 AS a_r, 0.4e0 AS b_t
FROM params"""


@query("a7_log_pivot", PIVOT_SQL)
def a7_log_pivot(spark, d):
    return _pivoted(runlog.pivot_log(runlog.param_lines(_params(spark, d))))


def _pivoted(rows):
    waves = F.col("waves")
    return rows.select(
        "*", waves[0]["theta"].alias("theta_p"), waves[2]["a"].alias("a_r"), waves[4]["b"].alias("b_t")
    ).drop("waves")


@query("a7_log_files", PIVOT_SQL)
def a7_log_files(spark, d):
    """Logs written as a table and read back."""
    path = scratch_path(spark, "logs")
    runlog.write_run_log(_params(spark, d), path)
    return _pivoted(runlog.read_run_log(spark, path, layout="table"))


@query("a7_form_layout", PIVOT_SQL.replace("series_n,", "CAST(NULL AS BIGINT) AS series_n,"))
def a7_form_layout(spark, d):
    """The saved-form layout: its own header, bare section names, numbered waves, angles in degrees."""
    rows = _params(spark, d).drop("series_n")
    line, wave = F.col("line"), F.col("_wave")
    # Each step is a column of its own, and a pattern is tried only on lines that can match it.
    lines = runlog.param_lines(rows).withColumn("line", F.when(line == runlog.HEADER, runlog.FORM_HEADER).otherwise(line))
    lines = lines.withColumn("line", F.when(line.endswith(")"), F.regexp_replace("line", r"\((radians|calculated)\)$", "")).otherwise(line))
    lines = lines.withColumn("_wave", F.when(line.contains(": ["), F.regexp_extract("line", r"^([PQRST]): \[", 1)).otherwise(""))
    lines = lines.withColumn("_value", F.when(wave != "", F.regexp_extract("line", r"\[(\S+)\t\]$", 1)).cast("double"))
    lines = lines.withColumn("_value", F.when(F.col("line_no") < 20, F.round(F.degrees("_value"), 9)).otherwise(F.col("_value")))
    numbered = F.concat(wave, F.lit(": ["), F.instr(F.lit("PQRST"), wave).cast("string"), F.lit("] = "), F.col("_value").cast("string"))
    lines = lines.withColumn("line", F.when(wave != "", numbered).otherwise(line))
    return _pivoted(runlog.pivot_log(lines.select("recording_id", "line_no", "line")))


# --- streams --------------------------------------------------------------------

@query("i1_replay_daily", """
SELECT CAST(user_id AS VARCHAR) AS recording_id, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS v_min, max(value) AS v_max
FROM events GROUP BY ALL""")
def i1_replay_daily(spark, d):
    kinds = table(spark, d, "events").schema
    stream = replay_source(spark, f"{d}/events.parquet", kinds)
    rows = stream.select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.timestamp_micros(clock.epoch_micros(stream, "ts")).alias("ts"), F.col("value").alias("v"),
    )
    days = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86_400).cast("int"))
    return replay_windows(rows, "1 day").select("recording_id", days.alias("day"), "n", "v_min", "v_max")


@query("i1_replay_resumed", """
SELECT CAST(user_id AS VARCHAR) AS recording_id, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS v_min, max(value) AS v_max
FROM events GROUP BY ALL""")
def i1_replay_resumed(spark, d):
    """The replay stopped after some files, in no order of time, and started again over all."""
    events = table(spark, d, "events")
    rows = events.select(
        F.col("user_id").cast("string").alias("recording_id"), F.timestamp_micros(clock.epoch_micros(events, "ts")).alias("ts"), F.col("value").alias("v"), "event_id",
    )
    source, out = scratch_path(spark, "replayed"), scratch_path(spark, "windows")
    kinds = rows.drop("event_id").schema
    for half in range(2):
        rows.where(F.pmod("event_id", F.lit(2)) == half).drop("event_id").write.mode("append").parquet(source)
        follow(replay_source(spark, source, kinds), out, "1 day", available_now=True).awaitTermination()
    days = F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86_400).cast("int"))
    return followed(spark, out, "1 day").select("recording_id", days.alias("day"), "n", "v_min", "v_max")


@query("i2_stream_segments", with_signal(SEGMENTS_SQL))
def i2_stream_segments(spark, d):
    path = scratch_path(spark, "samples")
    rows = signal(spark, d).select("recording_id", "idx", "t", "v")
    signals.ordered(rows).write.parquet(path)
    return stream_segments(replay_source(spark, path, rows.schema))
