"""Ordered operators on the signal; see :mod:`sigspark.operators.chunks` for the cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.chunks import (
    CHUNK, KEY, attach, carried, chunk_window, own_rows, unkeyed, with_chunk, with_halo,
)

# Voltage range a recording is scaled to.
SCALE_LO, SCALE_HI = -0.4, 1.2
# Fixed value: the snap half-width is the sampling rate divided by this, whole part.
SNAP_DIVISOR = 64


def neighbours(signal: DataFrame, columns: list[str], size: int = CHUNK) -> DataFrame:
    """Add ``prev_<column>``: the value one sample earlier, NULL on the first."""
    w = chunk_window()
    df = with_halo(signal, 1, 0, size)
    df = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    return unkeyed(own_rows(df, size).drop("chunk"))


# --- marking -----------------------------------------------------------------

def crossing_columns(df: DataFrame, waves: list) -> DataFrame:
    """``mark`` on chunked rows with ``theta``: see :func:`mark_crossings`."""
    w = chunk_window()
    here, following = F.col("theta"), F.lead("theta").over(w)
    code, nearer_is_here = F.lit(0), F.lit(False)
    for number, wave in reversed(list(enumerate(waves, start=1))):
        wave = wave if isinstance(wave, Column) else F.lit(wave)
        hit = (F.col("theta") <= wave) & (wave <= F.col("_next"))
        code = F.when(hit, number).otherwise(code)
        nearer_is_here = F.when(hit, wave - here < F.col("_next") - wave).otherwise(nearer_is_here)
    df = df.withColumn("_next", following).withColumn("_code", code).withColumn("_here", nearer_is_here)
    own = F.when((F.col("_code") > 0) & F.col("_here"), F.col("_code"))
    handed_on = F.lag(F.when((F.col("_code") > 0) & ~F.col("_here"), F.col("_code"))).over(w)
    return df.withColumn("mark", F.coalesce(own, handed_on, F.lit(0))).drop("_next", "_code", "_here")


def mark_crossings(signal: DataFrame, waves: list, size: int = CHUNK) -> DataFrame:
    """Mark the sample nearest to each wave angle passed by the phase ``theta``.

    A pair of neighbouring samples passes a wave if it lies between their phases; the
    first such wave in P..T order counts, and a tie goes to the later sample. A sample
    marked by both its pairs keeps the later pair's mark. ``waves`` are five numbers or
    columns.
    """
    return unkeyed(own_rows(crossing_columns(with_halo(signal, 1, 1, size), waves), size).drop("chunk"))


# --- snapping ----------------------------------------------------------------

def snap_width(sf_ecg: int) -> int:
    """Half-width in samples; below 64 Hz it is 0 and nothing moves."""
    return sf_ecg // SNAP_DIVISOR


def _reach(column: str, d: int, width: Column | None = None) -> list[Column]:
    """The column at -d, ..., 0, ..., +d samples, NULL beyond the ends and beyond ``width``."""
    w = chunk_window()
    near = [F.lag(column, -k).over(w) if k else F.col(column) for k in range(-d, d + 1)]
    return near if width is None else [F.when(width >= abs(k), c) for k, c in zip(range(-d, d + 1), near)]


def extreme_columns(df: DataFrame, d: int, value: str = "v", width: Column | None = None) -> DataFrame:
    """``max_idx``/``min_idx``: first place of the largest/smallest value within +-d samples.

    The neighbours are fetched by offset, which is much cheaper than an aggregate over a
    sliding frame of records. ``width`` narrows the reach of single rows.
    """
    near = [f"_near{k}" for k in range(2 * d + 1)]
    df = df.withColumns(dict(zip(near, _reach(value, d, width))))

    def first_place(best) -> Column:
        values = F.array(*near)
        return F.col("idx") + F.array_position(values, best(values)) - (d + 1)

    return df.withColumns({"max_idx": first_place(F.array_max), "min_idx": first_place(F.array_min)}).drop(*near)


def local_extremes(signal: DataFrame, d: int, size: int = CHUNK) -> DataFrame:
    return unkeyed(own_rows(extreme_columns(with_halo(signal, d, d, size), d), size).drop("chunk"))


def snap_columns(df: DataFrame, d: int, mark: str = "peak", value: str = "v", width: Column | None = None) -> DataFrame:
    """Replace ``mark`` by the snapped marks on chunked rows (needs a halo of 2d)."""
    df = extreme_columns(df, d, value, width)
    target = F.when(F.col(mark).isin(1, 3, 5), F.col("max_idx")).when(F.col(mark).isin(2, 4), F.col("min_idx"))
    # Target and code in one number, fetched from every neighbour; the latest sender wins.
    df = df.withColumn("_sent", target * 8 + F.col(mark))
    arrived = [
        F.when(F.floor(sent / 8) == F.col("idx"), F.pmod(sent, F.lit(8)).cast("int"))
        for sent in reversed([F.col(f"_from{k}") for k in range(2 * d + 1)])
    ]
    df = df.withColumns({f"_from{k}": sent for k, sent in enumerate(_reach("_sent", d))})
    return (
        df.withColumn(mark, F.coalesce(*arrived, F.lit(0)))
        .drop("_sent", "max_idx", "min_idx", *[f"_from{k}" for k in range(2 * d + 1)])
    )


def snap_peaks(signal: DataFrame, d: int, size: int = CHUNK) -> DataFrame:
    """Move P, R, T marks to the local maximum and Q, S marks to the local minimum.

    One pass: every mark moves once, from where it stood. If several meet on a sample the
    one from the latest sample stays. For the step-by-step rule see ``snap_peaks_exact``.
    """
    return unkeyed(own_rows(snap_columns(with_halo(signal, 2 * d, 2 * d, size), d), size).drop("chunk"))


# --- scaling -----------------------------------------------------------------

def scale_extent(signal: DataFrame, value: str = "v") -> DataFrame:
    return signal.groupBy("recording_id").agg(
        F.max("idx").alias("n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )


def scaled(value: str = "v", lo: float = SCALE_LO, hi: float = SCALE_HI) -> Column:
    """Scaled value from the attached extent; NULL on a flat recording."""
    return F.try_divide((F.col(value) - F.col("_min")) * (hi - lo), F.col("_max") - F.col("_min")) + lo


def minmax_scale(signal: DataFrame, lo: float = SCALE_LO, hi: float = SCALE_HI, size: int = CHUNK) -> DataFrame:
    """Map each recording to [lo, hi]."""
    df = attach(with_chunk(signal, size), scale_extent(signal), size)
    return unkeyed(df.withColumn("v", scaled("v", lo, hi)).drop("chunk", "n", "_min", "_max"))


def match_moments(
    signal: DataFrame, mean: Column, sd: Column, size: int = CHUNK, target: DataFrame | None = None
) -> DataFrame:
    """Rescale to standard deviation ``sd``, then add ``mean``; the old mean is not taken out.

    ``mean`` and ``sd`` may use ``_mean`` and ``_sd``, the recording's own moments, and the
    columns of ``target``, a table of one row per recording.
    """
    own = signal.groupBy("recording_id").agg(
        F.max("idx").alias("n"), F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_sd")
    )
    if target is not None:
        target = target.withColumnRenamed("recording_id", "_id")
        own = own.join(target, own["recording_id"].eqNullSafe(target["_id"])).drop("_id")
    df = attach(with_chunk(signal, size), own, size)
    return unkeyed(df.withColumn("v", F.col("v") * F.try_divide(sd, F.col("_sd")) + mean).select(*signal.columns))


# --- time --------------------------------------------------------------------

def second_ticks(signal: DataFrame, every: float = 1.0, size: int = CHUNK) -> DataFrame:
    """First sample of each new whole second (or of another step)."""
    stepped = signal.withColumn("tick", F.floor(F.col("t") / every).cast("bigint"))
    return neighbours(stepped, ["tick"], size).where(F.col("tick") > F.col("prev_tick")).drop("prev_tick")


def segments(signal: DataFrame, size: int = CHUNK) -> DataFrame:
    """Line pieces from the previous to the current sample; NULL start on the first."""
    return neighbours(signal, ["t", "v"], size).select(
        "recording_id", "idx",
        F.col("prev_t").alias("t0"), F.col("prev_v").alias("v0"),
        F.col("t").alias("t1"), F.col("v").alias("v1"),
    )


# --- beats -------------------------------------------------------------------

def running_sum(signal: DataFrame, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """Sum up to and including each row, along ``idx``."""
    df = with_chunk(signal, size)
    carry = carried(df, {"_sum": F.sum(value)}, {"_before": F.sum("_sum")})
    so_far = chunk_window().rowsBetween(Window.unboundedPreceding, 0)
    return unkeyed(
        df.withColumn(name, F.sum(value).over(so_far)).join(carry, list(KEY))
        # A chunk without a value so far takes the sum before it.
        .withColumn(name, F.when(F.col(name).isNotNull() | F.col("_before").isNotNull(), F.coalesce(name, F.lit(0)) + F.coalesce("_before", F.lit(0))))
        .drop("chunk", "_before")
    )


def beat_bounds(rr: DataFrame, sf: float, ticks: int = 1_000_000, size: int = CHUNK) -> DataFrame:
    """First and last sample of each beat from intervals ``rr`` in seconds.

    Beats end at the running time, rounded half-even to a sample. The time is summed in
    whole ticks per second, so the sum does not depend on the order of adding.
    """
    whole = rr.withColumn("_ticks", F.rint(F.col("rr") * ticks).cast("bigint"))
    summed = running_sum(whole, "_ticks", "_end", size)
    last = F.rint(F.col("_end") / (ticks / sf)).cast("bigint")
    first = F.rint((F.col("_end") - F.col("_ticks")) / (ticks / sf)).cast("bigint") + 1
    return summed.select(
        "recording_id", F.col("idx").alias("beat"), first.alias("start_idx"), last.alias("end_idx"), "rr"
    )


def rr_intervals(signal: DataFrame, size: int = CHUNK) -> DataFrame:
    """Beat intervals between R marks: ``(recording_id, idx, beat, t, rr)``.

    ``beat`` numbers the R marks from 1; the first has no interval. The last R mark and
    the number of R marks of earlier chunks are carried in.
    """
    marks = with_chunk(signal.where(F.col("peak") == 3).select("recording_id", "idx", "t"), size)
    carry = carried(
        marks,
        {"_count": F.count(F.lit(1)), "_last": F.max_by(F.struct("t"), "idx")},
        {"_beats": F.sum("_count"), "_prev": F.last("_last")},
    )
    w = chunk_window()
    inside = marks.withColumns({"_number": F.row_number().over(w), "_lag": F.lag(F.struct("t")).over(w)})
    return unkeyed(inside.join(carry, list(KEY))).select(
        "recording_id", "idx",
        (F.coalesce("_beats", F.lit(0)) + F.col("_number")).alias("beat"),
        "t",
        (F.col("t") - F.coalesce("_lag", "_prev")["t"]).alias("rr"),
    )


# --- plotting ----------------------------------------------------------------

def viewport(signal: DataFrame, start: int, width: int, zoom: float) -> DataFrame:
    """Samples from position ``start`` on that fall within ``width`` pixels of it.

    The first sample's time is one row per recording (``idx`` is dense, so it is read with an
    equality filter at the scan); the samples join it without an aggregate over them. Spark
    broadcasts the rows if they are few, and the filter on the pixel then comes before any
    shuffle; otherwise it splits hot recordings at run time.
    """
    first = signal.where(F.col("idx") == start).select(F.col("recording_id").alias("_id"), F.col("t").alias("_t0"))
    ahead = signal.where(F.col("idx") >= start)
    x = F.floor(F.col("t") / zoom) - F.floor(F.col("_t0") / zoom)
    return (
        ahead.join(first, ahead["recording_id"].eqNullSafe(first["_id"]))
        .withColumn("x", x.cast("bigint")).where(F.col("x") <= width)
        .drop("_id", "_t0")
    )


def decimate(signal: DataFrame, zoom: float) -> DataFrame:
    """One row per pixel column: extremes, first and last value."""
    return (
        signal.withColumn("x", F.floor(F.col("t") / zoom).cast("bigint"))
        .groupBy("recording_id", "x")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("v_min"), F.max("v").alias("v_max"),
            F.min_by("v", "idx").alias("v_first"), F.max_by("v", "idx").alias("v_last"),
        )
    )
