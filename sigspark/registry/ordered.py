"""Queries of the window (E), view (F), aggregate (D), join (C) and beat operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigspark import schema
from sigspark.functions.shapes import phase
from sigspark.operators import joins, stats, windows
from sigspark.operators.index import with_index
from sigspark.operators.snap_exact import snap_peaks_exact
from sigspark.plans.dataset import plan_dataset, union_plans
from sigspark.sources import screens
from sigspark.sources.runlog import param_lines, pivot_log
from sigspark.sources.scratch import scratch_path
from sigspark.registry.base import query, rounded
from sigspark.registry.scalars import RANGES_SQL, unit_sql
from sigspark.registry.tables import (
    ACTIVITY, CUSTOMER_SCENARIOS, activity, customer_scenarios, dbl, samples, signal, stored_signal, table, with_signal,
)

DAY = 86_400.0
LEVELS = (10.0, 20.0, 40.0, 80.0, 160.0)
ANGLES = tuple(math.radians(theta) for _, theta, _, _ in schema.DEFAULT_WAVES)
SNAP = 4


# --- aggregates ---------------------------------------------------------------

@query("d1_moments", with_signal("""
SELECT recording_id, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM sig GROUP BY ALL"""))
def d1_moments(spark, d):
    return stats.moments(samples(spark, d)).select("recording_id", "n", rounded("mean"), rounded("sd"))


@query("d2_extent", with_signal("""
SELECT recording_id, min(v) AS v_min, max(v) AS v_max, max(v) - min(v) AS v_range FROM sig GROUP BY ALL"""))
def d2_extent(spark, d):
    return stats.extent(samples(spark, d))


@query("d3_row_counts", with_signal("SELECT recording_id, count(*) AS n_rows FROM sig GROUP BY ALL"))
def d3_row_counts(spark, d):
    return stats.row_counts(samples(spark, d))


@query("d7_corpus_tally", """
SELECT o_orderstatus AS split, o_orderpriority AS activity, o_orderkey % 4 AS label, count(*) AS n_recordings
FROM orders GROUP BY ALL""")
def d7_corpus_tally(spark, d):
    return stats.corpus_tally(table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("activity"),
        (F.col("o_orderkey") % 4).alias("label"),
    ))


RR_SQL = """rr AS (
  SELECT recording_id, idx, row_number() OVER w AS beat, t, t - lag(t) OVER w AS rr
  FROM sig WHERE peak = 3 WINDOW w AS (PARTITION BY recording_id ORDER BY idx))"""


@query("d8_hr_summary", with_signal("""
SELECT recording_id, count(rr) AS n_rr, round(avg(rr), 6) AS rr_mean, round(stddev_samp(rr), 6) AS rr_sd,
       round(60 / avg(rr), 9) AS hr_mean, round(60 * stddev_samp(rr) / (avg(rr) * avg(rr)), 9) AS hr_sd
FROM rr WHERE rr IS NOT NULL GROUP BY recording_id""", RR_SQL))
def d8_hr_summary(spark, d):
    return stats.rr_moments(windows.rr_intervals(signal(spark, d))).select(
        "recording_id", "n_rr", rounded("rr_mean"), rounded("rr_sd"), rounded("hr_mean", 9), rounded("hr_sd", 9)
    )


# --- windows --------------------------------------------------------------------

def crossing_sql(source: str, levels) -> str:
    """Pairs of neighbours, then the last write per sample."""
    hit = " ".join(f"WHEN theta <= {dbl(p)} AND {dbl(p)} <= nxt THEN {i}" for i, p in enumerate(levels, start=1))
    near = " ".join(
        f"WHEN theta <= {dbl(p)} AND {dbl(p)} <= nxt THEN CASE WHEN {dbl(p)} - theta < nxt - {dbl(p)} THEN idx ELSE idx + 1 END"
        for p in levels
    )
    return f"""pairs AS (SELECT *, lead(theta) OVER (PARTITION BY recording_id ORDER BY idx) AS nxt FROM {source}),
writes AS (SELECT recording_id, idx AS pair_idx, CASE {hit} END AS code, CASE {near} END AS target FROM pairs),
marks AS (SELECT recording_id, target AS idx, arg_max(code, pair_idx) AS code FROM writes WHERE code IS NOT NULL GROUP BY ALL)"""


@query("e1_crossing", with_signal("""
SELECT s.recording_id, s.idx, coalesce(m.code, 0) AS mark FROM src s LEFT JOIN marks m USING (recording_id, idx)""",
    "src AS (SELECT recording_id, idx, v AS theta FROM sig)", crossing_sql("src", LEVELS)))
def e1_crossing(spark, d):
    sig = signal(spark, d).select("recording_id", "idx", F.col("v").alias("theta"))
    return windows.mark_crossings(sig, list(LEVELS)).select("recording_id", "idx", "mark")


@query("e1_crossing_phase", f"""
WITH src AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS idx,
                    atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS theta FROM embeddings),
{crossing_sql("src", ANGLES)}
SELECT s.recording_id, s.idx, coalesce(m.code, 0) AS mark FROM src s LEFT JOIN marks m USING (recording_id, idx)""")
def e1_crossing_phase(spark, d):
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("recording_id"), "vec_id", phase(e[0].cast("double"), e[1].cast("double")).alias("theta")
    )
    return windows.mark_crossings(with_index(rows, ["recording_id"], ["vec_id"]), list(ANGLES)).select(
        "recording_id", "idx", "mark"
    )


def _extreme_sql(best: str, codes: str) -> str:
    return with_signal(f"""
SELECT a.recording_id, a.idx, a.peak, {best} AS target
FROM sig a JOIN sig b ON a.recording_id = b.recording_id AND b.idx BETWEEN a.idx - {SNAP} AND a.idx + {SNAP}
WHERE a.peak IN {codes} GROUP BY a.recording_id, a.idx, a.peak""")


@query("e2_snap_max", _extreme_sql("arg_max(b.idx, (b.v, -b.idx))", "(1, 3, 5)"))
def e2_snap_max(spark, d):
    return windows.local_extremes(signal(spark, d), SNAP).where(F.col("peak").isin(1, 3, 5)).select(
        "recording_id", "idx", "peak", F.col("max_idx").alias("target")
    )


@query("e2_snap_min", _extreme_sql("arg_min(b.idx, (b.v, b.idx))", "(2, 4)"))
def e2_snap_min(spark, d):
    return windows.local_extremes(signal(spark, d), SNAP).where(F.col("peak").isin(2, 4)).select(
        "recording_id", "idx", "peak", F.col("min_idx").alias("target")
    )


def snap_sql(source: str, d: int) -> str:
    """One-pass snapping of the marks ``peak`` of a source with ``v``."""
    return f"""reach AS (
  SELECT a.recording_id, a.idx, a.peak, arg_max(b.idx, (b.v, -b.idx)) AS up, arg_min(b.idx, (b.v, b.idx)) AS down
  FROM {source} a JOIN {source} b ON a.recording_id = b.recording_id AND b.idx BETWEEN a.idx - {d} AND a.idx + {d}
  GROUP BY a.recording_id, a.idx, a.peak),
snapped AS (
  SELECT recording_id, target AS idx, arg_max(peak, idx) AS peak
  FROM (SELECT *, CASE WHEN peak IN (1, 3, 5) THEN up ELSE down END AS target FROM reach WHERE peak > 0)
  GROUP BY recording_id, target)"""


@query("e2_snap_peaks", with_signal("""
SELECT s.recording_id, s.idx, coalesce(p.peak, 0) AS peak FROM sig s LEFT JOIN snapped p USING (recording_id, idx)""",
    snap_sql("sig", SNAP)))
def e2_snap_peaks(spark, d):
    return windows.snap_peaks(signal(spark, d), SNAP).select("recording_id", "idx", "peak")


@query("e3_minmax", with_signal("""
SELECT recording_id, idx, round((v - min(v) OVER w) * 1.6 / nullif(max(v) OVER w - min(v) OVER w, 0) - 0.4, 6) + 0.0 AS v
FROM sig WINDOW w AS (PARTITION BY recording_id)"""))
def e3_minmax(spark, d):
    return windows.minmax_scale(signal(spark, d)).select("recording_id", "idx", rounded("v"))


@query("e5_ticks", with_signal("""
SELECT recording_id, idx, t, tick FROM (
  SELECT *, lag(tick) OVER (PARTITION BY recording_id ORDER BY idx) AS before
  FROM (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS tick FROM sig)) WHERE tick > before"""))
def e5_ticks(spark, d):
    return windows.second_ticks(signal(spark, d), DAY).select("recording_id", "idx", "t", "tick")


SEGMENTS_SQL = """
SELECT recording_id, idx, lag(t) OVER w AS t0, lag(v) OVER w AS v0, t AS t1, v AS v1
FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)"""


@query("e6_segments", with_signal(SEGMENTS_SQL))
def e6_segments(spark, d):
    return windows.segments(signal(spark, d))


@query("e7_index", with_signal("SELECT recording_id, idx, event_id FROM sig"))
def e7_index(spark, d):
    return signal(spark, d).select("recording_id", "idx", "event_id")


@query("e8_rr_intervals", with_signal("SELECT recording_id, idx, beat, t, rr FROM rr", RR_SQL))
def e8_rr_intervals(spark, d):
    return windows.rr_intervals(signal(spark, d))


@query("f2_viewport_slice", with_signal("""
SELECT recording_id, idx, t, v, x FROM (
  SELECT *, CAST(floor(t / 21600) - floor(first_value(t) OVER (PARTITION BY recording_id ORDER BY idx) / 21600) AS BIGINT) AS x
  FROM sig WHERE idx >= 10) WHERE x <= 50"""))
def f2_viewport_slice(spark, d):
    return windows.viewport(signal(spark, d), 10, 50, 21_600.0).select("recording_id", "idx", "t", "v", "x")


@query("f2_screen", with_signal("""
SELECT recording_id, idx, t, v, x FROM (
  SELECT *, CAST(floor(t / 21600) - floor(first_value(t) OVER (PARTITION BY recording_id ORDER BY idx) / 21600) AS BIGINT) AS x
  FROM sig WHERE idx >= 10 AND recording_id = (SELECT recording_id FROM sig GROUP BY recording_id ORDER BY count(*) DESC, recording_id LIMIT 1)) WHERE x <= 400"""))
def f2_screen(spark, d):
    """A screen of the longest recording, from a clustered table of all."""
    path = scratch_path(spark, "clustered")
    screens.write_clustered(signal(spark, d).select("recording_id", "idx", "t", "v"), path)
    longest = samples(spark, d).groupBy("recording_id").count().orderBy(F.desc("count"), "recording_id").first().recording_id
    return screens.screen(spark, path, longest, 10, 400, 21_600.0).select("recording_id", "idx", "t", "v", "x")


@query("f3_decimate", with_signal("""
SELECT recording_id, CAST(floor(t / 172800) AS BIGINT) AS x, count(*) AS n, min(v) AS v_min, max(v) AS v_max,
       arg_min(v, idx) AS v_first, arg_max(v, idx) AS v_last
FROM sig GROUP BY ALL"""))
def f3_decimate(spark, d):
    return windows.decimate(signal(spark, d), 2 * DAY)


@query("f3_pyramid", with_signal("\nUNION ALL\n".join(f"""
SELECT {level} AS level, recording_id, CAST(floor(t / {43200 * 4 ** level}) AS BIGINT) AS x, count(*) AS n, min(v) AS v_min, max(v) AS v_max,
       arg_min(v, idx) AS v_first, arg_max(v, idx) AS v_last
FROM sig GROUP BY ALL""" for level in range(3))))
def f3_pyramid(spark, d):
    path = scratch_path(spark, "pyramid")
    screens.write_pyramid(signal(spark, d), path, DAY / 2, factor=4, levels=3)
    return union_plans(*[screens.read_level(spark, path, level).withColumn("level", F.lit(level)) for level in range(3)])


# --- lookups and beats ------------------------------------------------------------

@query("c1_range_lookup", f"""
WITH {RANGES_SQL}
SELECT c_custkey, c.activity, max(lo) FILTER (param = 'hr_mean') AS hr_mean_lo, max(hi) FILTER (param = 'hr_mean') AS hr_mean_hi,
       max(lo) FILTER (param = 'hr_std') AS hr_std_lo, max(hi) FILTER (param = 'hr_std') AS hr_std_hi
FROM (SELECT c_custkey, {ACTIVITY} AS activity FROM customer) c LEFT JOIN rng ON c.activity = rng.activity
GROUP BY ALL""")
def c1_range_lookup(spark, d):
    plan = table(spark, d, "customer").select("c_custkey", activity().alias("activity"))
    ranges = joins.widen_ranges(schema.activity_ranges(spark), ["hr_mean", "hr_std"])
    return joins.lookup_ranges(plan, ranges).select(
        "c_custkey", "activity", "hr_mean_lo", "hr_mean_hi", "hr_std_lo", "hr_std_hi"
    )


@query("c2_plan_expand", f"""
WITH {CUSTOMER_SCENARIOS}
SELECT folder, activity, CAST(unnest(range(samples)) AS INTEGER) AS sample_no FROM scen""")
def c2_plan_expand(spark, d):
    return joins.expand_plan(customer_scenarios(spark, d)).select("folder", "activity", "sample_no")


@query("c3_hold_asof", with_signal("""
SELECT c.recording_id, c.idx, c.t, p.v AS rr
FROM (SELECT * FROM sig WHERE peak = 2) c ASOF LEFT JOIN (SELECT * FROM sig WHERE peak = 3) p
  ON c.recording_id = p.recording_id AND c.t >= p.t"""))
def c3_hold_asof(spark, d):
    sig = signal(spark, d)
    points = sig.where(F.col("peak") == 2).select("recording_id", "idx", "t")
    steps = sig.where(F.col("peak") == 3).select("recording_id", "t", F.col("v").alias("rr"))
    return joins.hold_asof(points, steps)


@query("c3_hold_grid", with_signal("""
SELECT a.recording_id, a.idx, (a.idx - 1) / 256e0 AS t, b.v AS rr
FROM sig a LEFT JOIN sig b ON a.recording_id = b.recording_id AND b.idx = (a.idx - 1) // 2 + 1"""))
def c3_hold_grid(spark, d):
    sig = signal(spark, d)
    points = sig.select("recording_id", "idx", ((F.col("idx") - 1) / 256.0).alias("t"))
    return joins.hold_on_grid(points, sig.select("recording_id", "idx", F.col("v").alias("rr")), 128)


BEATS_SQL = """beats AS (
  SELECT recording_id, idx AS beat, v AS rr,
         CAST(round_even((cum - h) / 1000.0, 0) AS BIGINT) + 1 AS start_idx, CAST(round_even(cum / 1000.0, 0) AS BIGINT) AS end_idx
  FROM (SELECT *, sum(h) OVER (PARTITION BY recording_id ORDER BY idx) AS cum
        FROM (SELECT *, CAST(round(v * 100) AS BIGINT) AS h FROM sig)))"""


def _beats(spark, d):
    """Values as intervals; a tenth of a sample per second, so 1000 hundredths make one."""
    rr = signal(spark, d).select("recording_id", "idx", F.col("v").alias("rr"))
    return windows.beat_bounds(rr, 0.1, ticks=100)


@query("e4_running_time", with_signal("SELECT recording_id, beat, start_idx, end_idx, rr FROM beats", BEATS_SQL))
def e4_running_time(spark, d):
    return _beats(spark, d)


@query("c4_beat_expand", with_signal("""
SELECT recording_id, unnest(generate_series(start_idx, end_idx)) AS idx, beat, rr FROM beats""", BEATS_SQL))
def c4_beat_expand(spark, d):
    return joins.expand_beats(_beats(spark, d))


# --- plans ---------------------------------------------------------------------

@query("g1_train_eval_union", """
SELECT 'Env1' AS folder, o_orderpriority AS activity, o_orderkey % 4 AS label FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'Env2', o_orderpriority, o_orderkey % 4 FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'Eval', o_orderpriority, o_orderkey % 4 FROM orders""")
def g1_train_eval_union(spark, d):
    orders = table(spark, d, "orders")

    def plan(folder, rows):
        return rows.select(
            F.lit(folder).alias("folder"), F.col("o_orderpriority").alias("activity"), (F.col("o_orderkey") % 4).alias("label")
        )

    status = F.col("o_orderstatus")
    return union_plans(plan("Env1", orders.where(status == "F")), plan("Env2", orders.where(status == "O")), plan("Eval", orders))


def _draw_sql(param: str, lo: str, hi: str) -> str:
    return f"{lo} + ({hi} - {lo}) * {unit_sql('42', 'folder', 'activity', 'sample_no', repr(param))}"


START_US = 1_767_225_600_000_000  # 2026-01-01T00:00:00Z
PLAN_SQL = f"""{CUSTOMER_SCENARIOS}, {RANGES_SQL},
wide AS (SELECT activity, {", ".join(f"max({e}) FILTER (param = '{p}') AS {p}_{e}" for p in schema.RANGE_PARAMS for e in ("lo", "hi"))} FROM rng GROUP BY activity),
plan AS (SELECT *, CAST(unnest(range(samples)) AS INTEGER) AS sample_no FROM (SELECT *, row_number() OVER (ORDER BY folder, activity, label) - 1 AS us FROM scen)),
drawn AS (
SELECT '2026-01-01T00_00_00' || CASE WHEN us = 0 THEN '' WHEN us % 1000 = 0 THEN '_' || lpad(CAST(us // 1000 AS VARCHAR), 3, '0') ELSE '_' || lpad(CAST(us AS VARCHAR), 6, '0') END
       || 'Z_' || CAST(label AS VARCHAR) || '_' || p.activity || '_' || lpad(CAST(sample_no AS VARCHAR), 4, '0') AS recording_id,
       folder AS split, p.activity, label, sample_no,
       {", ".join(f"{_draw_sql(p, p + '_lo', p + '_hi')} AS {p}" for p in schema.RANGE_PARAMS)},
       {_draw_sql('noise_amp', 'noise_min', 'noise_max')} AS noise_amp,
       CAST(1 + floor({unit_sql('42', 'folder', 'activity', 'sample_no', "'seed'")} * 42) AS INTEGER) AS seed,
       27 + floor({unit_sql('42', 'folder', 'activity', 'sample_no', "'a_r'")} * 18) AS a_r,
       {_draw_sql('b_r', '0.08e0', '0.12e0')} AS b_r,
       512 AS sf, 256 AS sf_ecg, 256 AS n_beats, 0.01e0 AS f_lo_std, 0.01e0 AS f_hi_std, 1.4e0 AS plot_amp, CAST(3 AS BIGINT) AS period_ms,
       hr_mean_lo IS NOT NULL AS valid, CASE WHEN hr_mean_lo IS NULL THEN 'unknown activity: ' || p.activity END AS reason
FROM (SELECT *, activity AS act FROM plan) p LEFT JOIN (SELECT * RENAME (activity AS known) FROM wide) w ON p.activity = w.known)"""
DRAWN = (*schema.RANGE_PARAMS, "noise_amp", "b_r")


def _plan(spark, d):
    return plan_dataset(customer_scenarios(spark, d), schema.activity_ranges(spark), 42, START_US)


@query("k1_plan_dataset", f"""
WITH {PLAN_SQL}
SELECT * REPLACE ({", ".join(f"round({c}, 9) AS {c}" for c in DRAWN)}), a_r AS wave_a, round(b_r, 9) AS wave_b FROM drawn""")
def k1_plan_dataset(spark, d):
    plan = _plan(spark, d)
    wave = F.col("waves")[2]
    return plan.select(
        *[rounded(c, 9) if c in DRAWN else F.col(c) for c in plan.columns if c != "waves"],
        wave["a"].alias("wave_a"), F.round(wave["b"], 9).alias("wave_b"),
    )


@query("k1_plan_log", f"""
WITH {PLAN_SQL}
SELECT recording_id, n_beats, sf_ecg, sf, {", ".join(f"round({c}, 9) AS {c}" for c in ("noise_amp", "hr_mean", "hr_std", "f_lo", "f_hi", "lf_hf_ratio"))},
       f_hi_std, f_lo_std, period_ms, CAST(NULL AS BIGINT) AS series_n, a_r, round(b_r, 9) AS b_r, 0.75e0 AS a_t FROM drawn WHERE valid""")
def k1_plan_log(spark, d):
    """The plan's valid rows as log lines and back."""
    back = pivot_log(param_lines(_plan(spark, d).where("valid")))
    waves = F.col("waves")
    numbers = ("noise_amp", "hr_mean", "hr_std", "f_lo", "f_hi", "lf_hf_ratio")
    return back.select(
        *[rounded(c, 9) if c in numbers else F.col(c) for c in back.columns if c != "waves"],
        waves[2]["a"].alias("a_r"), F.round(waves[2]["b"], 9).alias("b_r"), waves[4]["a"].alias("a_t"),
    )


# --- exact snapping ---------------------------------------------------------------

@query("k6_snap_exact", "WITH RECURSIVE " + with_signal(f"""
SELECT recording_id, unnest(range(1, len(marks) + 1)) AS idx, unnest(marks) AS peak FROM walk WHERE step = len(marks)""",
f"""reach AS (
  SELECT a.recording_id, a.idx, a.peak, arg_max(b.idx, (b.v, -b.idx)) AS up, arg_min(b.idx, (b.v, b.idx)) AS down
  FROM sig a JOIN sig b ON a.recording_id = b.recording_id AND b.idx BETWEEN a.idx - {SNAP} AND a.idx + {SNAP}
  GROUP BY a.recording_id, a.idx, a.peak)""",
"""recs AS (
  SELECT recording_id, list(peak ORDER BY idx) AS marks, list(up ORDER BY idx) AS ups, list(down ORDER BY idx) AS downs
  FROM reach GROUP BY recording_id)""",
"""walk AS (
  SELECT recording_id, CAST(0 AS BIGINT) AS step, marks, ups, downs FROM recs
  UNION ALL
  SELECT recording_id, i, CASE WHEN marks[i] = 0 OR target = i THEN marks
         WHEN target > i THEN marks[1:i - 1] || [0] || marks[i + 1:target - 1] || [marks[i]] || marks[target + 1:]
         ELSE marks[1:target - 1] || [marks[i]] || marks[target + 1:i - 1] || [0] || marks[i + 1:] END, ups, downs
  FROM (SELECT *, step + 1 AS i, CASE WHEN marks[step + 1] IN (1, 3, 5) THEN ups[step + 1] ELSE downs[step + 1] END AS target FROM walk)
  WHERE i <= len(marks))""").removeprefix("WITH "))
def k6_snap_exact(spark, d):
    sig = stored_signal(spark, d).select("recording_id", "idx", "v", "peak")
    return snap_peaks_exact(sig, SNAP).select("recording_id", "idx", "peak")
