"""Table shapes and the fixed tables that come with the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAVES = ("P", "Q", "R", "S", "T")

SIGNAL = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("v", T.DoubleType()),
    T.StructField("peak", T.IntegerType()),
])

# One row of a delimited recording file.
SAMPLE_FILE = T.StructType([
    T.StructField("Time", T.DoubleType()),
    T.StructField("Voltage", T.DoubleType()),
    T.StructField("Peak", T.IntegerType()),
])

WAVE_TYPE = "array<struct<wave:string,theta:double,a:double,b:double>>"

# Default parameters of a recording.
DEFAULTS = {
    "n_beats": 256,
    "sf_ecg": 256,
    "sf": 512,
    "seed": 1,
    "noise_amp": 0.1,
    "hr_mean": 60.0,
    "hr_std": 1.0,
    "plot_amp": 1.4,
    "f_lo": 0.1,
    "f_hi": 0.25,
    "f_lo_std": 0.01,
    "f_hi_std": 0.01,
    "lf_hf_ratio": 0.5,
}

# Wave shapes as (wave, angle in degrees, height a, width b).
DEFAULT_WAVES = (
    ("P", -60.0, 1.2, 0.25),
    ("Q", -15.0, -5.0, 0.1),
    ("R", 0.0, 30.0, 0.1),
    ("S", 15.0, -7.5, 0.1),
    ("T", 90.0, 0.75, 0.4),
)

# Scenario rows (folder, activity, label, samples, noise_min, noise_max).
SCENARIOS = (
    ("Env1", "Resting-Normal", 0, 200, 0.06, 0.12),
    ("Env2", "Resting-Abnormal", 1, 200, 0.07, 0.16),
    ("Env3", "Working-Normal", 2, 200, 0.08, 0.18),
    ("Env4", "Working-Abnormal", 3, 200, 0.10, 0.22),
    ("Eval", "Resting-Normal", 0, 80, 0.05, 0.14),
    ("Eval", "Resting-Abnormal", 1, 80, 0.06, 0.16),
    ("Eval", "Working-Normal", 2, 80, 0.08, 0.20),
    ("Eval", "Working-Abnormal", 3, 80, 0.10, 0.24),
    ("Eval", "Working-Overlap", 3, 80, 0.12, 0.26),
)

# Centre and half-width of the ranges drawn from, by activity.
# (activity, hr_std, hr_std half-width, hr_mean from, hr_mean to,
#  lf_hf_ratio, f_lo, f_lo half-width, f_hi, f_hi half-width)
_ACTIVITY = (
    ("Resting-Normal", 1.6475, 0.1, 50.0, 56.0, 0.5, 0.1, 0.03, 0.25, 0.05),
    ("Resting-Abnormal", 1.3693, 0.1, 60.0, 65.0, 0.5, 0.1, 0.03, 0.25, 0.05),
    ("Resting-Overlap", 1.5084, 0.04, 56.5, 59.5, 0.5, 0.1, 0.03, 0.25, 0.05),
    ("Working-Normal", 2.211, 0.1, 65.0, 73.0, 1.0, 0.25, 0.03, 0.25, 0.03),
    ("Working-Abnormal", 2.494, 0.1, 126.0, 140.0, 1.0, 0.25, 0.03, 0.25, 0.03),
    ("Working-Overlap", 2.3525, 0.04, 73.0, 126.0, 1.0, 0.25, 0.03, 0.25, 0.03),
)
_LF_HF_HALF_WIDTH = 0.15

RANGE_PARAMS = ("hr_std", "hr_mean", "lf_hf_ratio", "f_lo", "f_hi")


def activity_range_rows() -> list[tuple[str, str, float, float]]:
    """Long form ``(activity, param, lo, hi)`` of the range table; half-open ranges."""
    rows = []
    for act, sd, sd_w, hr_lo, hr_hi, ratio, flo, flo_w, fhi, fhi_w in _ACTIVITY:
        for param, lo, hi in (
            ("hr_std", sd - sd_w, sd + sd_w),
            ("hr_mean", hr_lo, hr_hi),
            ("lf_hf_ratio", ratio - _LF_HF_HALF_WIDTH, ratio + _LF_HF_HALF_WIDTH),
            ("f_lo", flo - flo_w, flo + flo_w),
            ("f_hi", fhi - fhi_w, fhi + fhi_w),
        ):
            rows.append((act, param, lo, hi))
    return rows


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def values_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A small literal table as a local relation.

    A local relation carries its exact size, so Spark's own broadcast threshold
    decides about joins with it; no hint is needed.
    """
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def scenarios(spark: SparkSession) -> DataFrame:
    return values_table(spark, "folder, activity, label, samples, noise_min, noise_max", SCENARIOS)


def activity_ranges(spark: SparkSession) -> DataFrame:
    return values_table(spark, "activity, param, lo, hi", activity_range_rows())


def default_waves():
    """The default wave array as a column."""
    return F.array(*[
        F.struct(
            F.lit(wave).alias("wave"), F.lit(theta).alias("theta"),
            F.lit(a).alias("a"), F.lit(b).alias("b"),
        )
        for wave, theta, a, b in DEFAULT_WAVES
    ]).cast(WAVE_TYPE)
