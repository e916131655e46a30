"""Queries of the spectral operators and the composed plans (D4-D6, K2-K5)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigspark.operators import spectral
from sigspark.operators.chunks import lengths
from sigspark.plans.annotate import annotate_each
from sigspark.plans.hrv import hrv_features
from sigspark.plans.surrogate import surrogate
from sigspark.registry.base import query, rounded
from sigspark.registry.ordered import DAY, RR_SQL, crossing_sql, snap_sql
from sigspark.registry.scalars import unit_sql
from sigspark.registry.tables import samples, signal, stored_signal, with_signal
from sigspark.schema import DEFAULT_WAVES, default_waves

KMAX = 8
MANY_BINS = 70
BANDS = {"lf": (0.0, 0.06), "hf": (0.06, 0.13)}
BEAT_BANDS = {"lf": (0.0, 0.2), "hf": (0.2, 0.5)}


def dft_sql(source: str, name: str, last: str) -> str:
    """Bins 0 or 1 to ``last`` of a source ``(recording_id, idx, v)`` by plain sums."""
    return f"""{name}_n AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM {source}),
{name}_k AS (SELECT *, unnest(range({last})) AS k FROM {name}_n),
{name} AS (SELECT recording_id, n, k, sum(v * cos(2 * pi() * (k * (idx - 1) % n) / n)) AS re,
                  sum(-v * sin(2 * pi() * (k * (idx - 1) % n) / n)) AS im
           FROM {name}_k GROUP BY recording_id, n, k)"""


@query("d4_dft", with_signal("""
SELECT recording_id, n, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM spec WHERE k >= 1""",
    dft_sql("sig", "spec", str(KMAX + 1))))
def d4_dft(spark, d):
    return spectral.dft(signal(spark, d), KMAX).select("recording_id", "n", "k", rounded("re", 5), rounded("im", 5))


@query("d4_dft_many", with_signal("""
SELECT recording_id, n, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM spec WHERE k >= 1""",
    dft_sql("sig", "spec", str(MANY_BINS + 1))))
def d4_dft_many(spark, d):
    return spectral.dft(signal(spark, d), MANY_BINS).select("recording_id", "n", "k", rounded("re", 5), rounded("im", 5))


@query("d5_idft", with_signal("""
SELECT recording_id, j + 1 AS idx, round(sum(re * cos(2 * pi() * (k * j % n) / n) - im * sin(2 * pi() * (k * j % n) / n)) / n, 5) + 0.0 AS v
FROM (SELECT *, unnest(range(n)) AS j FROM spec) GROUP BY recording_id, n, j""",
    dft_sql("sig", "spec", "n")))
def d5_idft(spark, d):
    sig = stored_signal(spark, d)
    kinds = spectral.survey_lengths(lengths(sig))
    return spectral.idft(spectral.dft_fast(sig, kinds=kinds), kinds=kinds).select("recording_id", "idx", rounded("v", 5))


BAND_SQL = """sum(CASE WHEN k / n >= {lo} AND k / n < {hi} THEN re * re + im * im ELSE 0 END)"""


def band_sql(bands, name: str) -> str:
    return BAND_SQL.format(lo=f"{bands[name][0]}e0", hi=f"{bands[name][1]}e0")


@query("d6_band_ratio", with_signal(f"""
SELECT recording_id, round(lf, 3) + 0.0 AS lf_power, round(hf, 3) + 0.0 AS hf_power, round(lf / nullif(hf, 0), 6) AS lf_hf_ratio
FROM (SELECT recording_id, {band_sql(BANDS, "lf")} AS lf, {band_sql(BANDS, "hf")} AS hf FROM spec WHERE k >= 1 GROUP BY recording_id)""",
    dft_sql("sig", "spec", "n")))
def d6_band_ratio(spark, d):
    return spectral.band_power(spectral.dft_fast(signal(spark, d)), BANDS, 1.0).select(
        "recording_id", rounded("lf_power", 3), rounded("hf_power", 3), rounded("lf_hf_ratio")
    )


@query("k5_dft_fast", with_signal("""
SELECT recording_id, n, k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM spec""",
    dft_sql("sig", "spec", "n")))
def k5_dft_fast(spark, d):
    return spectral.dft_fast(signal(spark, d)).select("recording_id", "n", "k", rounded("re", 5), rounded("im", 5))


@query("k2_surrogate", with_signal("""
SELECT recording_id, j + 1 AS idx, round(w * target_sd / nullif(stddev_samp(w) OVER (PARTITION BY recording_id), 0) + target_mean, 5) + 0.0 AS v
FROM back JOIN (SELECT recording_id, avg(v) AS target_mean, stddev_samp(v) AS target_sd FROM sig GROUP BY ALL) USING (recording_id)""",
    dft_sql("sig", "spec", "n"),
    f"""phased AS (
  SELECT recording_id, n, k, CASE WHEN k = 0 THEN 0 ELSE sqrt(re * re + im * im) END AS amp,
         CASE WHEN k = 0 OR 2 * k = n THEN 0 WHEN 2 * k > n THEN -p ELSE p END AS ph
  FROM (SELECT *, 2 * pi() * {unit_sql('9', 'recording_id', 'least(k, n - k)')} AS p FROM spec))""",
    """back AS (
  SELECT recording_id, n, j, sum(amp * cos(ph) * cos(2 * pi() * (k * j % n) / n) - amp * sin(ph) * sin(2 * pi() * (k * j % n) / n)) / n AS w
  FROM (SELECT *, unnest(range(n)) AS j FROM phased) GROUP BY recording_id, n, j)"""))
def k2_surrogate(spark, d):
    out = surrogate(stored_signal(spark, d).select("recording_id", "idx", "v"), 9)
    return out.select("recording_id", "idx", rounded("v", 5))


# (q, rate, noise, heart rate) of the recordings by their number modulo three.
K3_SETS = ((2, 256, 0.1, 60.0), (1, 128, 0.05, 72.0), (4, 64, 0.2, 54.0))


def _adjusted(hr_mean: float) -> list[float]:
    f = math.sqrt(hr_mean / 60.0)
    by_wave = {"P": math.sqrt(f), "Q": f, "S": f}
    return [math.radians(theta) * by_wave.get(wave, 1.0) for wave, theta, _, _ in DEFAULT_WAVES]


def _k3_sql(number: int, q: int, rate: int, noise: float, hr_mean: float) -> str:
    parts = ",\n".join([
        f"src AS (SELECT recording_id, (idx - 1) // {q} + 1 AS idx, v, atan2(sin(v), cos(v)) AS theta FROM sig"
        f" WHERE (idx - 1) % {q} = 0 AND CAST(recording_id AS BIGINT) % 3 = {number})",
        crossing_sql("src", _adjusted(hr_mean)),
        "marked AS (SELECT s.recording_id, s.idx, s.v, coalesce(m.code, 0) AS peak FROM src s LEFT JOIN marks m USING (recording_id, idx))",
        snap_sql("marked", rate // 64),
    ])
    return f"""SELECT * FROM (WITH {parts}
SELECT s.recording_id, s.idx, (s.idx - 1) / {rate}e0 AS t,
       round((v - min(v) OVER w) * 1.6 / nullif(max(v) OVER w - min(v) OVER w, 0) - 0.4
             + {noise!r}e0 * (2 * {unit_sql('11', 's.recording_id', 's.idx')} - 1), 6) + 0.0 AS v,
       coalesce(p.peak, 0) AS peak
FROM src s LEFT JOIN snapped p ON s.recording_id = p.recording_id AND s.idx = p.idx
WINDOW w AS (PARTITION BY s.recording_id))"""


@query("k3_annotate", with_signal("\nUNION ALL\n".join(_k3_sql(k, *one) for k, one in enumerate(K3_SETS))))
def k3_annotate(spark, d):
    state = signal(spark, d).select("recording_id", "idx", F.cos("v").alias("x"), F.sin("v").alias("y"), "v")
    number = F.col("recording_id").cast("bigint") % 3
    values = [F.element_at(F.array(*map(F.lit, column)), number.cast("int") + 1) for column in zip(*K3_SETS)]
    params = samples(spark, d).select("recording_id").distinct().select(
        "recording_id", *[v.alias(c) for v, c in zip(values, ("q", "sf_ecg", "noise_amp", "hr_mean"))], default_waves().alias("waves")
    )
    out = annotate_each(state, params, 11)
    return out.select("recording_id", "idx", "t", rounded("v"), "peak")


@query("k4_hrv_features", with_signal(f"""
SELECT c.recording_id, n_samples, n_rr, round(rr_mean, 6) AS rr_mean, round(rr_sd, 6) AS rr_sd,
       round(60 / rr_mean, 6) AS hr_mean, round(60 * rr_sd / (rr_mean * rr_mean), 6) AS hr_sd,
       round(lf, 6) + 0.0 AS lf_power, round(hf, 6) + 0.0 AS hf_power, round(lf / nullif(hf, 0), 6) AS lf_hf_ratio
FROM (SELECT recording_id, count(*) AS n_samples FROM sig GROUP BY ALL) c
LEFT JOIN (SELECT recording_id, count(v) AS n_rr, avg(v) AS rr_mean, stddev_samp(v) AS rr_sd FROM series GROUP BY ALL) m USING (recording_id)
LEFT JOIN (SELECT recording_id, {band_sql(BEAT_BANDS, "lf")} AS lf, {band_sql(BEAT_BANDS, "hf")} AS hf
           FROM spec WHERE k >= 1 GROUP BY recording_id) b USING (recording_id)""",
    RR_SQL.replace("t - lag(t) OVER w", "t / 86400 - lag(t / 86400) OVER w"),
    "series AS (SELECT recording_id, beat - 1 AS idx, rr AS v FROM rr WHERE rr IS NOT NULL)",
    dft_sql("series", "spec", "n")))
def k4_hrv_features(spark, d):
    days = signal(spark, d).withColumn("t", F.col("t") / DAY)
    out = hrv_features(days, BEAT_BANDS)
    return out.select("recording_id", "n_samples", *[c if c == "n_rr" else rounded(c) for c in (
        "n_rr", "rr_mean", "rr_sd", "hr_mean", "hr_sd", "lf_power", "hf_power", "lf_hf_ratio")])
