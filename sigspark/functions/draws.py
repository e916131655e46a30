"""Reproducible draws: a pure function of a seed and the row's keys.

No state is carried between rows, so a retried task, another partitioning or
another engine gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_draw(seed, *keys) -> Column:
    """A number in [0, 1) made from the first 32 bits of a digest of the keys."""
    parts = [_text(k) for k in (seed, *keys)]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform(lo, hi, seed, *keys) -> Column:
    """A number in [lo, hi)."""
    lo, hi = _col(lo), _col(hi)
    return lo + (hi - lo) * unit_draw(seed, *keys)


def uniform_int(lo: int, hi: int, seed, *keys) -> Column:
    """A whole number in [lo, hi], both ends included."""
    return (F.lit(lo) + F.floor(unit_draw(seed, *keys) * (hi - lo + 1))).cast("int")


def mirrored_phase(seed, recording_id, k, n) -> Column:
    """A phase in [0, 2*pi) per frequency; the upper half mirrors it with the other sign.

    Bin 0 and, for even lengths, bin n/2 get phase 0, so the inverse transform is real.
    """
    k, n = _col(k), _col(n)
    lower = F.least(k, n - k)
    phase = 2 * F.pi() * unit_draw(seed, recording_id, lower)
    return (
        F.when((k == 0) | (k * 2 == n), F.lit(0.0))
        .when(k * 2 > n, -phase)
        .otherwise(phase)
    )


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _text(x) -> Column:
    """Column names and columns as text; numbers as literals."""
    return _col(x).cast("string")
