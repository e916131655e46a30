"""Text columns: peak names, axis numbers, recording names and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigspark.schema import WAVES

# File-name patterns, read from the right because the time part varies.
NAME_PATTERN = r"^(.+Z)_(\d+)_([A-Za-z-]+)_(\d{4,})\.csv$"
SHORT_NAME_PATTERN = r"^([^_]+)_(\d+)_([A-Za-z-]+)\.csv$"


def decode_peak(peak: Column) -> Column:
    """Wave name of a peak code; empty for code 0."""
    names = F.array(*[F.lit(w) for w in WAVES])
    return F.when(peak.between(1, len(WAVES)), F.element_at(names, peak)).when(peak == 0, "")


def format_axis(x: Column, up: float, lo: float, precision: int) -> Column:
    """Axis text: plain decimals for 0 and for lo < abs(x) <= up, else exponent form."""
    digits = "0.00" if precision == 2 else "0.0"
    plain = (x == 0) | ((F.abs(x) <= up) & (F.abs(x) > lo))

    def fmt(pattern):
        return F.call_function("format_number", x, F.lit(pattern))

    return F.when(plain, fmt(digits)).otherwise(fmt(digits + "E0"))


def recording_name(instant: Column, label: Column, activity: Column, sample_no: Column) -> Column:
    """File stem ``<time>_<label>_<activity>_<0000>`` from the time as ISO text."""
    stamp = F.translate(instant, ":./", "__")
    return F.format_string(
        "%s_%d_%s_%04d", stamp, label, F.translate(activity, " ", "-"), sample_no
    )


def name_parts(name: Column) -> Column:
    """Time, label, activity and, in the full form, counter of a ``.csv`` file name.

    An array of 4 or 3 texts; a name of neither form gives an array of 1. Each pattern is
    matched once, however many parts are used.
    """
    mark = "\u0001"
    full = F.regexp_replace(name, NAME_PATTERN, mark.join(("$1", "$2", "$3", "$4")))
    either = F.regexp_replace(full, SHORT_NAME_PATTERN, mark.join(("$1", "$2", "$3")))
    return F.split(either, mark)
