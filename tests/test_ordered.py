"""Ordered operators against plain Python, with chunks small enough to cross edges often."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigspark.operators import joins, snap_exact, spectral, stats, windows
from sigspark.operators.chunks import explode_range
from sigspark.operators.index import cut_keys, with_index
from sigspark.operators.snap_exact import snap_peaks_exact
from sigspark.plans.annotate import annotate, annotate_each
from sigspark.plans.hrv import hrv_features
from sigspark.plans.surrogate import surrogate
from sigspark.schema import DEFAULT_WAVES, default_waves
from sigspark.sources.scratch import scratch_root

SIZE = 5
LENGTHS = {"a": 1, "b": 2, "c": 23, "d": 57}


def make_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for rec, n in LENGTHS.items():
        t = 0.0
        for i in range(1, n + 1):
            t += rng.choice([0.25, 0.5, 1.5, 4.0])
            rows.append((rec, i, t, float(rng.randint(0, 9)), rng.choice([0, 0, 1, 2, 3, 3, 4, 5])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def sig(spark, rows):
    scratch_root(spark)
    df = spark.createDataFrame(rows, "recording_id string, idx bigint, t double, v double, peak int")
    return df.repartition(7).persist()


def by_rec(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_with_index_cuts_hot_keys(spark, rows):
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame([(r[0], r[2], r[1]) for r in shuffled], "k string, t double, want bigint")
    for piece_rows in (3, 1 << 20):
        out = with_index(df, ["k"], ["t"], piece_rows=piece_rows)
        assert out.where("idx <> want").count() == 0
        assert out.count() == len(rows)


def test_with_index_cuts_ties_and_dense_stretches(spark):
    # One instant holds half of the key, and a thousandth of its span another quarter.
    rows = [("k", 1.0, i) for i in range(64)] + [("k", 2.0 + i / 32_000, i) for i in range(32)] + [("k", 100.0 + i, i) for i in range(32)]
    rows = [(*r, n) for n, r in enumerate(rows, start=1)]
    df = spark.createDataFrame(rows, "k string, t double, id bigint, want bigint").repartition(5)
    cuts = {None: 64, ("t", "id"): 16}
    for cut_along, largest in cuts.items():
        out = with_index(df, ["k"], ["t", "id"], piece_rows=4, cut_along=cut_along and list(cut_along))
        assert out.where("idx <> want").count() == 0 and out.count() == len(rows)
        cut, pieces = cut_keys(df, ["k"], ["t", "id"], 4, cut_along and list(cut_along))
        assert cut.groupBy("k", *pieces).count().agg(F.max("count")).first()[0] <= largest


def test_with_index_puts_rows_without_order_first(spark):
    df = spark.createDataFrame([("k", None if i < 3 else float(i), i) for i in range(20)], "k string, t double, id bigint")
    assert with_index(df, ["k"], ["t", "id"], piece_rows=4).where("idx <> id + 1").count() == 0


@pytest.mark.parametrize("kind", ["even", "outlier", "nameless", "text", "odd"])
def test_hot_keys_are_cut_whatever_their_order_column(spark, kind):
    rng = random.Random(3)
    n, piece = 4000, 200
    order = [float(i) for i in range(n)]
    if kind == "outlier":
        order[-1] = 1e15
    if kind == "odd":
        order[:3], order[-3:] = [None, None, float("-inf")], [float("inf"), float("nan"), float("nan")]
    rows = [(None if kind == "nameless" else "k", f"{i:05d}" if kind == "text" else order[i], i) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"k string, t {'string' if kind == 'text' else 'double'}, id bigint").repartition(4)
    assert with_index(df, ["k"], ["t", "id"], piece_rows=piece).where("idx <> id + 1").count() == 0
    cut, pieces = cut_keys(df, ["k"], ["t", "id"], piece)
    assert cut.groupBy("k", *pieces).count().agg(F.max("count")).first()[0] <= 4 * piece


def test_a_burst_is_cut_along_the_next_column(spark):
    df = spark.createDataFrame([("k", 1.0 if i < 3000 else float(i), i) for i in range(4000)], "k string, t double, id bigint")
    assert with_index(df, ["k"], ["t", "id"], piece_rows=200, cut_along=["t", "id"]).where("idx <> id + 1").count() == 0
    cut, pieces = cut_keys(df, ["k"], ["t", "id"], 200, ["t", "id"])
    assert cut.groupBy("k", *pieces).count().agg(F.max("count")).first()[0] <= 800


def test_explode_range_in_blocks(spark):
    df = spark.createDataFrame([(1, 3, 11), (2, 5, 5), (3, 6, 5)], "id bigint, lo bigint, hi bigint")
    want = [(1, i) for i in range(3, 12)] + [(2, 5)]
    assert got(explode_range(df, "lo", "hi", "x", block=4), "id", "x") == want


def test_segments_and_ticks(sig, rows):
    want_seg, want_tick = [], []
    for rec, rs in by_rec(rows).items():
        for before, r in zip([None, *rs], rs):
            want_seg.append((rec, r[1], before and before[2], r[2]))
            if before and math.floor(r[2] / 2) > math.floor(before[2] / 2):
                want_tick.append((rec, r[1]))
    seg = windows.segments(sig, SIZE)
    assert sorted((tuple(r) for r in seg.select("recording_id", "idx", "t0", "t1").collect()), key=str) == sorted(want_seg, key=str)
    assert got(windows.second_ticks(sig, 2.0, SIZE), "recording_id", "idx") == want_tick


def crossings(theta, levels):
    """Marks by walking the samples; positions from 1."""
    marks = [0] * (len(theta) + 1)
    for i in range(1, len(theta)):
        one, two = theta[i - 1], theta[i]
        for code, p in enumerate(levels, start=1):
            if one <= p <= two:
                marks[i if p - one < two - p else i + 1] = code
                break
    return marks[1:]


def test_mark_crossings(sig, rows):
    levels = [1.5, 3.0, 4.5, 6.0, 7.0]
    want = []
    for rec, rs in by_rec(rows).items():
        want += [(rec, i, m) for i, m in enumerate(crossings([r[3] for r in rs], levels), start=1)]
    df = sig.withColumn("theta", F.col("v"))
    assert got(windows.mark_crossings(df, levels, SIZE), "recording_id", "idx", "mark") == sorted(want)


def test_crossing_tie_goes_to_the_later_sample(spark):
    df = spark.createDataFrame([("x", 1, 0.0), ("x", 2, 0.5)], "recording_id string, idx bigint, theta double")
    assert got(windows.mark_crossings(df, [0.25, 9.0, 9.0, 9.0, 9.0]), "idx", "mark") == [(1, 0), (2, 1)]


def extreme(v, i, d, code):
    lo, hi = max(1, i - d), min(len(v), i + d)
    reach = range(lo, hi + 1)
    best = max if code % 2 else min
    value = best(v[j - 1] for j in reach)
    return next(j for j in reach if v[j - 1] == value)


def snapped_once(v, marks, d):
    out = [0] * (len(v) + 1)
    for i, code in enumerate(marks, start=1):
        if code:
            out[extreme(v, i, d, code)] = code
    return out[1:]


def snapped_in_place(v, marks, d):
    marks = [0, *marks]
    for i in range(1, len(v) + 1):
        code = marks[i]
        if code:
            j = extreme(v, i, d, code)
            if j != i:
                marks[j], marks[i] = code, 0
    return marks[1:]


@pytest.mark.parametrize("rule", [snapped_once, snapped_in_place])
@pytest.mark.parametrize("d", [1, 4])
def test_snap(sig, rows, rule, d):
    want = []
    for rec, rs in by_rec(rows).items():
        out = rule([r[3] for r in rs], [r[4] for r in rs], d)
        want += [(rec, i, m) for i, m in enumerate(out, start=1)]
    snap = windows.snap_peaks if rule is snapped_once else snap_peaks_exact
    assert got(snap(sig, d, SIZE), "recording_id", "idx", "peak") == sorted(want)


def one_recording(spark, v, peaks):
    return spark.createDataFrame(
        [("x", i, float(x), p) for i, (x, p) in enumerate(zip(v, peaks), start=1)],
        "recording_id string, idx bigint, v double, peak int",
    )


def peaks_of(df):
    return [r.peak for r in df.orderBy("idx").collect()]


def test_snap_hand_cases(spark):
    tie = one_recording(spark, [1, 5, 5, 1], [0, 3, 0, 0])
    assert peaks_of(windows.snap_peaks(tie, 2)) == [0, 3, 0, 0]
    rising = one_recording(spark, range(12), [3] + [0] * 11)
    assert peaks_of(windows.snap_peaks(rising, 1)) == [0, 3] + [0] * 10
    for size in (1, 3, 100):  # the mark walks over every chunk edge
        assert peaks_of(snap_peaks_exact(rising, 1, size)) == [0] * 11 + [3]
    both = one_recording(spark, [1, 2, 9, 2, 1], [0, 3, 0, 3, 0])
    assert peaks_of(windows.snap_peaks(both, 1)) == [0, 0, 3, 0, 0]
    assert windows.snap_width(256) == 4 and windows.snap_width(32) == 0
    assert peaks_of(snap_peaks_exact(tie, windows.snap_width(32))) == [0, 3, 0, 0]


@pytest.mark.parametrize("d, size", [(1, 1), (3, 7), (4, 16)])
def test_exact_snap_over_long_slopes(spark, monkeypatch, d, size):
    """Marks pass a hundred chunks; kinds meet, merge and overwrite each other on the way."""
    tries = []
    plain = snap_exact._try_states
    monkeypatch.setattr(snap_exact, "_try_states", lambda size, states: tries.append(states) or plain(size, states))
    rng, rows, want = random.Random(d), [], []
    n = 100 * size
    for name, slope, share in (("up", 1, 0.02), ("down", -1, 0.02), ("dense", 1, 0.6), ("rough", 1, 0.3), ("flat", 0, 0.5), ("waves", 1, 0.2)):
        v, marks = [], []
        for i in range(n):
            step = rng.choice([-1.5, 1, 2]) if name == "rough" else 1 if name != "waves" or (i // (7 * size)) % 2 else -1
            v.append((v[-1] if v else 0.0) + slope * step)
            marks.append(rng.choice([1, 2, 3, 4, 5]) if rng.random() < share else 0)
        rows += [(name, i + 1, float(v[i]), marks[i]) for i in range(n)]
        want += [(name, i, m) for i, m in enumerate(snapped_in_place(v, marks, d), start=1)]
    df = spark.createDataFrame(rows, "recording_id string, idx bigint, v double, peak int")
    assert got(snap_peaks_exact(df, d, size), "recording_id", "idx", "peak") == sorted(want)
    assert len(tries) <= 4


def test_scaling(sig, rows, spark):
    out = windows.minmax_scale(sig, size=SIZE).groupBy("recording_id").agg(F.min("v"), F.max("v"))
    figures = {r[0]: (r[1], r[2]) for r in out.collect()}
    assert figures["d"] == (-0.4, pytest.approx(1.2)) and figures["a"] == (None, None)
    matched = windows.match_moments(sig, F.lit(2.0), F.lit(0.5), SIZE).groupBy("recording_id").agg(F.stddev_samp("v"))
    assert {r[0]: r[1] for r in matched.collect()}["d"] == pytest.approx(0.5)


def test_beats(sig, rows):
    want = []
    for rec, rs in by_rec(rows).items():
        end = 0
        for r in rs:
            start, end = end + 1, end + int(r[3])
            want += [(rec, i, r[1]) for i in range(start, end + 1)]
    rr = sig.select("recording_id", "idx", F.col("v").alias("rr"))
    beats = windows.beat_bounds(rr, 1.0, ticks=10, size=SIZE)
    assert got(joins.expand_beats(beats), "recording_id", "idx", "beat") == sorted(want)


def test_beat_ends_round_half_even(spark):
    rr = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 1.0), ("x", 3, 1.0)], "recording_id string, idx bigint, rr double")
    assert got(windows.beat_bounds(rr, 1.0), "beat", "start_idx", "end_idx") == [(1, 1, 0), (2, 1, 2), (3, 3, 2)]


def test_rr_intervals(sig, rows):
    want = []
    for rec, rs in by_rec(rows).items():
        before = None
        for beat, r in enumerate((r for r in rs if r[4] == 3), start=1):
            want.append((rec, r[1], beat, before is not None and r[2] - before))
            before = r[2]
    out = [(a, b, c, x if x is not None else False) for a, b, c, x in got_raw(windows.rr_intervals(sig, SIZE))]
    assert sorted(out, key=str) == sorted(want, key=str)


def got_raw(df):
    return [tuple(r) for r in df.select("recording_id", "idx", "beat", "rr").collect()]


def test_hold_asof(sig, rows):
    want = []
    for rec, rs in by_rec(rows).items():
        held = None
        for r in rs:
            if r[4] == 3:
                held = r[3]
            if r[4] in (0, 3):
                want.append((rec, r[1], held))
    points = sig.where("peak in (0, 3)").select("recording_id", "t", "idx")
    steps = sig.where("peak = 3").select("recording_id", "t", F.col("v").alias("rr"))
    for span in (3.0, 1e6):
        out = joins.hold_asof(points, steps, span)
        assert sorted((tuple(r) for r in out.select("recording_id", "idx", "rr").collect()), key=str) == sorted(want, key=str)


def test_viewport_and_decimate(sig, rows):
    want = []
    for rec, rs in by_rec(rows).items():
        ahead = [r for r in rs if r[1] >= 4]
        want += [(rec, r[1]) for r in ahead if math.floor(r[2] / 0.5) - math.floor(ahead[0][2] / 0.5) <= 20]
    assert got(windows.viewport(sig, 4, 20, 0.5), "recording_id", "idx") == want
    total = windows.decimate(sig, 3.0).agg(F.sum("n")).first()[0]
    assert total == len(rows)


# --- spectra --------------------------------------------------------------------

FFT_LENGTHS = (1, 2, 7, 16, 17, 23, 48, 64, 100, 101)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    data = {f"r{n}": rng.normal(size=n) for n in FFT_LENGTHS}
    rows = [(k, i + 1, float(x)) for k, v in data.items() for i, x in enumerate(v)]
    return data, spark.createDataFrame(rows, "recording_id string, idx bigint, v double").repartition(5).persist()


def check_bins(df, data, first=0, last=None):
    bins = {}
    for r in df.collect():
        bins.setdefault(r.recording_id, {})[r.k] = complex(r.re, r.im)
    for rec, v in data.items():
        want = np.fft.fft(v)
        ks = range(first, len(v) if last is None else last + 1)
        assert sorted(bins[rec]) == list(ks)
        for k in ks:
            assert bins[rec][k] == pytest.approx(want[k % len(v)], abs=1e-8), (rec, k)


@pytest.mark.parametrize("group_rows", [1 << 18, 16, 4])
def test_dft_fast_by_group_grid_and_chirp(series, group_rows):
    data, df = series
    check_bins(spectral.dft_fast(df, size=SIZE, group_rows=group_rows), data)


def test_survey_of_lengths(spark):
    lengths = spark.createDataFrame([(64,), (12,)], "n bigint")
    assert spectral.survey_lengths(lengths, 100) == (0, 0)
    assert spectral.survey_lengths(lengths, 8) == (2, 0)
    assert spectral.survey_lengths(spark.createDataFrame([(23,), (5,)], "n bigint"), 8) == (0, 2)
    # Beyond the square of a group: three sides and more, for powers of two and for padded lengths.
    assert spectral.survey_lengths(spark.createDataFrame([(256,), (101,)], "n bigint"), 8) == (3, 3)
    assert spectral.survey_lengths(spark.createDataFrame([(1 << 45,), (3 << 40,), ((1 << 44) + 1,)], "n bigint")) == (3, 3)


def test_squares_of_long_positions(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(m // 2), m) for m in (2 * rng.randrange(1, 1 << 52) for _ in range(200))]
    found = spark.createDataFrame(pairs, "j bigint, m bigint").select("j", "m", spectral._square_mod(F.col("j"), F.col("m")).alias("s"))
    assert all(r.s == r.j * r.j % r.m for r in found.collect())


@pytest.mark.parametrize("n", [256, 101])
def test_transforms_of_three_and_four_sides(spark, n):
    """Groups of 8 values: 256 as a deep grid, 101 through a padded length; several recordings of a length."""
    rng = np.random.default_rng(n)
    data = {f"r{k}": rng.normal(size=n) for k in range(3)}
    df = spark.createDataFrame([(r, i + 1, float(x)) for r, v in data.items() for i, x in enumerate(v)], "recording_id string, idx bigint, v double")
    spectrum = spectral.dft_fast(df, size=SIZE, group_rows=8).persist()
    check_bins(spectrum, data)
    back = {(r.recording_id, r.idx): r.v for r in spectral.idft(spectrum, 8).collect()}
    assert len(back) == 3 * n and all(back[r, i] == pytest.approx(x, abs=1e-9) for r, v in data.items() for i, x in enumerate(v, start=1))


def test_dft_in_blocks(series):
    data, df = series
    check_bins(spectral.dft(df, 40, size=SIZE), data, 1, 40)


@pytest.mark.parametrize("kmax", [33, 64, 65, 512])
def test_many_bins_in_one_pass(series, kmax):
    data, df = series
    out = spectral.dft(df, kmax, size=SIZE)
    check_bins(out, data, 1, kmax)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInPandas") == 1 and "_block" not in plan.split("MapInPandas")[0]


def test_hold_cuts_bursts_by_rows(spark):
    """A thousand points and steps within a second, and rows of one instant: NULL times, ties, values before the first step."""
    rng = random.Random(6)
    times = [rng.random() for _ in range(1000)] + [0.5] * 30 + [float(k) for k in range(-5, 200, 7)]
    points = [("hot", t, k) for k, t in enumerate(times)] + [("hot", None, -1), ("cold", 3.0, -2), ("none", 1.0, -3), (None, 0.4, -4)]
    steps = [("hot", rng.random(), float(k)) for k in range(400)] + [("hot", 0.5, 1000.0), ("hot", None, 5.0), ("cold", 2.0, None), ("cold", 1.0, 7.0), (None, 0.1, 9.0)]
    p = spark.createDataFrame(points, "recording_id string, t double, no bigint").repartition(4)
    s = spark.createDataFrame(steps, "recording_id string, t double, rr double").repartition(4)
    want = {}
    for name, t, no in points:
        held = [(u, rr) for n, u, rr in steps if n == name and u is not None and t is not None and u <= t]
        want[no] = max(held, key=lambda h: h[0])[1] if held else None
    for piece_rows in (50, 1 << 20):
        out = joins.hold_asof(p, s, piece_rows)
        assert out.columns == ["recording_id", "t", "no", "rr"] and {r.no: r.rr for r in out.collect()} == want


@pytest.mark.parametrize("group_rows", [1 << 18, 16])
def test_idft_inverts(series, group_rows):
    data, df = series
    spectrum = spectral.dft_fast(df, size=SIZE, group_rows=1 << 18)
    back = {(r.recording_id, r.idx): r.v for r in spectral.idft(spectrum, group_rows).collect()}
    assert len(back) == sum(FFT_LENGTHS)
    for rec, v in data.items():
        for i, x in enumerate(v, start=1):
            assert back[rec, i] == pytest.approx(x, abs=1e-9)


def test_surrogate_keeps_moments_and_spectrum(series):
    data, df = series
    out = surrogate(df, 5, size=SIZE)
    copies = {}
    for r in out.orderBy("idx").collect():
        copies.setdefault(r.recording_id, []).append(r.v)
    for n in (23, 64):
        v, copy = data[f"r{n}"], np.array(copies[f"r{n}"])
        assert copy.mean() == pytest.approx(v.mean()) and copy.std(ddof=1) == pytest.approx(v.std(ddof=1))
        ratio = np.abs(np.fft.fft(copy))[1:] / np.abs(np.fft.fft(v))[1:]
        inner = [k for k in range(n - 1) if 2 * (k + 1) != n]
        assert np.allclose(ratio[inner], ratio[0])
        assert not np.allclose(copy, v)


def test_annotate_does_not_depend_on_chunks(sig):
    state = sig.withColumns({"x": F.cos("v"), "y": F.sin("v")}).select("recording_id", "idx", "x", "y", "v")
    waves = [-1.0, -0.3, 0.0, 0.3, 1.5]
    few, many = (got(annotate(state, waves, 2, 256, 0.1, 7, size), "recording_id", "idx", "t", "v", "peak") for size in (SIZE, 1 << 16))
    assert str(few) == str(many) and len(few) == sum(-(-n // 2) for n in LENGTHS.values())
    values = [r[3] for r in few if r[0] == "d"]
    assert -0.5 <= min(values) and max(values) < 1.3


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_each_recording_with_its_own_rate(spark, size):
    """Rates far apart, and recordings without parameters, next to the same recordings on their own."""
    rng = random.Random(12)
    sets = {"fast": (1, 1000, 0.1), "slow": (1, 64, 0.05), "usual": (2, 256, 0.2), "still": (1, 32, 0.1), None: (1, 500, 0.3)}
    rows = [(name, i, math.cos(i / 9), math.sin(i / 9), rng.random()) for name in (*sets, "unknown") for i in range(1, 301)]
    state = spark.createDataFrame(rows, "recording_id string, idx bigint, x double, y double, v double").repartition(5)
    params = spark.createDataFrame([(n, *p, 60.0) for n, p in sets.items()], "recording_id string, q int, sf_ecg int, noise_amp double, hr_mean double")
    out = annotate_each(state, params.withColumn("waves", default_waves()), 3, size).persist()
    angles = [math.radians(theta) for _, theta, _, _ in DEFAULT_WAVES]
    near = lambda df: sorted((r.idx, round(r.t, 9), round(r.v, 9), r.peak) for r in df.select("idx", "t", "v", "peak").collect())
    for name, (q, rate, noise) in sets.items():
        own = F.col("recording_id").eqNullSafe(F.lit(name))
        assert near(out.where(own)) == near(annotate(state.where(own), angles, q, rate, noise, 3, size))
        assert out.where(own & (F.col("peak") > 0)).count() > 10
    rest = out.where("recording_id = 'unknown'").collect()
    assert sorted(r.idx for r in rest) == list(range(1, 301)) and {(r.t, r.v, r.peak) for r in rest} == {(None, None, 0)}
    none = annotate_each(state, params.withColumn("waves", default_waves()).limit(0), 3, size)
    assert none.count() == len(rows) and none.where("peak > 0 OR v IS NOT NULL").count() == 0


def test_rr_moments(spark):
    rr = spark.createDataFrame([("x", None), ("x", 1.0), ("x", 0.5)], "recording_id string, rr double")
    row = stats.rr_moments(rr).first()
    assert (row.n_rr, row.rr_mean, row.hr_mean) == (2, 0.75, 80.0)


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_nameless_recordings_keep_their_rows(spark, size):
    """Operators with joins give the answer of plain windows, null keys and times included."""
    rows = [(rec, i, None if i == 5 else i * 0.5, float(i * 7 % 5), 3 if i % 2 else 0) for rec in ("a", None) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "recording_id string, idx bigint, t double, v double, peak int")
    w = Window.partitionBy("recording_id")
    plain = df.withColumn("v", (F.col("v") - F.min("v").over(w)) * 1.6 / (F.max("v").over(w) - F.min("v").over(w)) - 0.4)
    near = lambda d, *c: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*c).collect())
    assert near(windows.minmax_scale(df, size=size), "recording_id", "idx", "v") == near(plain, "recording_id", "idx", "v")
    along = w.orderBy("idx")
    summed = df.withColumn("s", F.sum("v").over(along))
    assert near(windows.running_sum(df, "v", "s", size), "recording_id", "idx", "s") == near(summed, "recording_id", "idx", "s")
    marks = df.where("peak = 3")
    beats = marks.select("recording_id", "idx", F.row_number().over(along).alias("beat"), (F.col("t") - F.lag("t").over(along)).alias("rr"))
    assert near(windows.rr_intervals(df, size), "recording_id", "idx", "beat", "rr") == near(beats, "recording_id", "idx", "beat", "rr")
    points = spark.createDataFrame([(None, 2.2), ("a", None), ("a", 3.9), ("b", 1.0)], "recording_id string, t double")
    steps = df.select("recording_id", "t", F.col("v").alias("rr"))
    held = {(r.recording_id, r.t): r.rr for r in joins.hold_asof(points, steps, size * 0.4).collect()}
    assert held == {(None, 2.2): 3.0, ("a", None): None, ("a", 3.9): 4.0, ("b", 1.0): None}
    assert spectral.dft(df, 3, size=size).where("recording_id IS NULL").count() == 3


def test_bands_take_every_bin(spark):
    """A thousand beats with a fast ripple: the high band must not be cut off."""
    rr = [("a", i, sum(1 + 0.1 * (k % 3 == 0) for k in range(i)), 0.0, 3) for i in range(1, 1002)]
    df = spark.createDataFrame(rr, "recording_id string, idx bigint, t double, v double, peak int")
    row = hrv_features(df, {"lf": (0.0, 0.2), "hf": (0.2, 0.5)}, size=100).first()
    series = np.array([rr[k + 1][2] - rr[k][2] for k in range(1000)])
    power = np.abs(np.fft.fft(series)) ** 2
    f = np.arange(1000) / 1000
    assert abs(row.hf_power - power[(f >= 0.2) & (f < 0.5)].sum()) < 1e-6 and row.hf_power > 100
