"""Numeric column functions for signals, waves and spectra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plot frame of 290 pixels with the zero line in the middle, one below the top.
FRAME_AMPLITUDE = 145
ORIGIN_Y = 146
DEFAULT_ZOOM = 0.008
ZOOM_STEP = 2.0


def deg2rad(degrees: Column) -> Column:
    return F.radians(degrees)


def rate_factor(hr_mean: Column) -> Column:
    """How much wave widths stretch at a heart rate, relative to 60 per minute."""
    return F.sqrt(hr_mean / 60.0)


def adjust_angle(wave: Column, theta: Column, hr_mean: Column) -> Column:
    """Wave angle at a heart rate: P moves by the root of the factor, Q and S by the factor."""
    f = rate_factor(hr_mean)
    return F.when(wave == "P", theta * F.sqrt(f)).when(wave.isin("Q", "S"), theta * f).otherwise(theta)


def adjust_width(b: Column, hr_mean: Column) -> Column:
    return b * rate_factor(hr_mean)


def rate_adjust_waves(waves: Column, hr_mean: Column) -> Column:
    """Both adjustments on a wave array, angles turned from degrees to radians."""
    return F.transform(waves, lambda w: F.struct(
        w["wave"].alias("wave"),
        adjust_angle(w["wave"], deg2rad(w["theta"]), hr_mean).alias("theta"),
        w["a"].alias("a"),
        adjust_width(w["b"], hr_mean).alias("b"),
    ))


def wrap_angle(x: Column) -> Column:
    """Remainder to the nearest whole turn, in [-pi, pi]; halves go to the even turn."""
    turn = 2 * F.pi()
    return x - turn * F.rint(x / turn)


def phase(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def bump_sum(angle: Column, waves: Column) -> Column:
    """Slope template at a phase: the five wave bumps summed over the wave array."""
    def bump(w):
        d = wrap_angle(angle - w["theta"])
        return -w["a"] * d * F.exp(-(d * d) / (2 * w["b"] * w["b"]))

    return F.aggregate(F.transform(waves, bump), F.lit(0.0), lambda acc, x: acc + x)


def baseline_wander(t: Column, f: Column, amp: float = 0.005) -> Column:
    return amp * F.sin(2 * F.pi() * f * t)


def add_noise(v: Column, amp, u: Column) -> Column:
    """Symmetric noise of at most ``amp`` from a draw in [0, 1)."""
    return v + amp * (2 * u - 1)


def next_pow2(n: Column) -> Column:
    """The smallest power of two that is not below n."""
    guess = F.pow(F.lit(2.0), F.rint(F.ln(n) / F.ln(F.lit(2.0))))
    return F.when(guess >= n, F.when(guess / 2 >= n, guess / 2).otherwise(guess)).otherwise(guess * 2).cast("bigint")


def sample_period_ms(sf_ecg: Column) -> Column:
    """Whole milliseconds per sample."""
    return F.floor(F.try_divide(F.lit(1000), sf_ecg)).cast("bigint")


def angular_rate(rr: Column) -> Column:
    return F.try_divide(2 * F.pi(), rr)


def two_band_power(f: Column, f_lo, f_hi, f_lo_std, f_hi_std, ratio) -> Column:
    """Power at frequency f of two Gaussian bands, the lower one weighted by ``ratio``."""
    def band(centre, width, weight):
        w = 2 * F.pi() * (f - centre)
        c = 2 * F.pi() * width
        return weight * F.exp(-0.5 * (w * w) / (c * c)) / F.sqrt(2 * F.pi() * c * c)

    return band(f_lo, f_lo_std, ratio) + band(f_hi, f_hi_std, F.lit(1.0))


def two_band_amplitude(sf, power: Column) -> Column:
    return sf / 2.0 * F.sqrt(power)


def pixel_x(t: Column, zoom: float = DEFAULT_ZOOM, t_start: Column | None = None) -> Column:
    x = (t / zoom).cast("bigint")
    return x if t_start is None else x - (t_start / zoom).cast("bigint")


def pixel_y(v: Column, amp) -> Column:
    return ORIGIN_Y - (v * FRAME_AMPLITUDE / amp).cast("bigint")


def zoomed(zoom: float, steps: int) -> float:
    """Zoom after ``steps`` presses of zoom-in (positive) or zoom-out (negative)."""
    return zoom / ZOOM_STEP ** steps
