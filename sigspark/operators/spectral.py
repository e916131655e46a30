"""Spectra of recordings: few bins by sums, all bins by grouped transforms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.shapes import next_pow2, two_band_amplitude, two_band_power
from sigspark.operators.chunks import CHUNK, attach, explode_range, keyed, lengths, unkeyed, with_chunk
from sigspark.operators.groups import map_groups
from sigspark.sources.scratch import scratch_root

# Bins summed as columns side by side; more are summed in numpy.
BINS_PER_PASS = 32
# Longest series transformed inside one group.
GROUP_ROWS = 1 << 20
# Sides of a grid at most; five of 2^13 are beyond any length with exact angles.
SIDES = 5

_BINS = ["recording_id", "n", "k", "re", "im"]


def _angle(k: Column, j: Column, n: Column) -> Column:
    """2*pi*k*j/n with the turns taken out in whole numbers."""
    return 2 * F.pi() * F.pmod(k * j, n) / n


def dft(signal: DataFrame, kmax: int, value: str = "v", size: int = CHUNK) -> DataFrame:
    """Bins 1..kmax of each recording: ``(recording_id, n, k, re, im)``, sign -1, unscaled.

    Each sample is read once and adds to the sums of all bins, which are combined before the
    shuffle; no sample is paired with a frequency as a row. Up to ``BINS_PER_PASS`` bins are
    column sums; more are summed batch by batch in numpy (:func:`_batch_bins`). A NULL adds
    nothing; without any value the few bins are NULL, the many are left out.
    """
    base = signal.select("recording_id", "idx", F.col(value).alias("_v"))
    df = attach(with_chunk(base, size), lengths(base), size)
    if kmax > BINS_PER_PASS:
        rows = df.where(F.col("_v").isNotNull()).select("recording_id", "n", "idx", F.col("_v").cast("double"))
        sums = rows.mapInPandas(_batch_bins(kmax), "recording_id string, n bigint, re array<double>, im array<double>")
        bins = sums.select("recording_id", "n", F.posexplode(F.arrays_zip("re", "im")).alias("_k", "_bin")).groupBy("recording_id", "n", "_k").agg(
            F.sum("_bin.re").alias("re"), F.sum("_bin.im").alias("im"))
        return unkeyed(bins.select("recording_id", "n", (F.col("_k") + 1).cast("bigint").alias("k"), "re", "im"))
    n, j = F.col("n"), F.col("idx") - 1
    sums = []
    for b in range(1, kmax + 1):
        a = _angle(F.lit(b).cast("bigint"), j, n)
        sums += [F.sum(F.col("_v") * F.cos(a)).alias(f"_re{b}"), F.sum(-F.col("_v") * F.sin(a)).alias(f"_im{b}")]
    bins = F.array(*[
        F.struct(F.lit(b).cast("bigint").alias("k"), F.col(f"_re{b}").alias("re"), F.col(f"_im{b}").alias("im")) for b in range(1, kmax + 1)
    ])
    return unkeyed(df.groupBy("recording_id", "n").agg(*sums).select("recording_id", "n", F.inline(bins)))


def _batch_bins(kmax: int):
    """What the rows of a batch add to bins 1..kmax of their recordings.

    The turn of bin ``64 a + b`` is that of ``64 a`` times that of ``b``, each worked out in whole
    numbers first, so a row costs a product per bin and few angles.
    """
    blocks = -(-kmax // 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["recording_id", "idx"], kind="stable")
            for s in range(0, len(batch), 4096):
                rows = batch.iloc[s : s + 4096]
                name, n, j, v = rows["recording_id"].to_numpy(), rows["n"].to_numpy(), rows["idx"].to_numpy() - 1, rows["_v"].to_numpy()
                first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                turn = lambda k: np.exp(-2j * np.pi * ((j[:, None] * k) % n[:, None]) / n[:, None])
                low, high = turn(np.arange(1, 65)) * v[:, None], turn(64 * np.arange(blocks))
                sums = np.concatenate([np.add.reduceat(low * high[:, [a]], first, axis=0) for a in range(blocks)], axis=1)[:, :kmax]
                yield pd.DataFrame({"recording_id": name[first], "n": n[first], "re": list(sums.real), "im": list(sums.imag)})

    return run


def band_power(spectrum: DataFrame, bands: dict[str, tuple[float, float]], sf: float) -> DataFrame:
    """Power per frequency band ``[lo, hi)`` in the unit of ``sf``; ``lf``/``hf`` also as a ratio.

    ``spectrum`` must have every bin of the bands. The constant and the mirrored upper half
    are left out.
    """
    f = F.col("k") * sf / F.col("n")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    out = spectrum.where((F.col("k") >= 1) & (2 * F.col("k") <= F.col("n"))).groupBy("recording_id").agg(*[
        F.sum(F.when((f >= lo) & (f < hi), power).otherwise(0.0)).alias(f"{name}_power")
        for name, (lo, hi) in bands.items()
    ])
    if {"lf", "hf"} <= set(bands):
        out = out.withColumn("lf_hf_ratio", F.try_divide("lf_power", "hf_power"))
    return out


def two_band_spectrum(params: DataFrame, n: int, sf: float) -> DataFrame:
    """Target amplitude per bin of each parameter row, mirrored about n/2.

    The frequencies are angular, as are the band centres and widths.
    """
    grid = params.withColumns({"_first": F.lit(0).cast("bigint"), "_last": F.lit(n - 1).cast("bigint")})
    grid = explode_range(grid, "_first", "_last", "k", spread_by=params.columns).drop("_first", "_last")
    f = F.least(F.col("k"), n - F.col("k")) * (sf / n)
    power = two_band_power(
        f, F.col("f_lo"), F.col("f_hi"), F.col("f_lo_std"), F.col("f_hi_std"), F.col("lf_hf_ratio")
    )
    return grid.withColumn("amplitude", two_band_amplitude(F.lit(sf), power))


# --- all bins ----------------------------------------------------------------
# Between steps a series is told apart by ``recording_id`` and the whole-number columns in
# ``outer``; these stay with it.

def _transform_groups(df: DataFrame, keys: list[str], carried: list[str], position: str, frequency: str, inverse: bool) -> DataFrame:
    """Transform each group of ``keys``: ``_len`` values at ``position``, absent ones zero.

    ``carried`` are whole numbers, the same on all rows of a group, that the result keeps. Both
    directions are unscaled.
    """
    fields = ["recording_id", *carried]

    def transform(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        at, size = rows[position].to_numpy(), rows["_len"].to_numpy()[starts]
        values = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        def spectrum(series):
            return np.fft.ifft(series) * series.shape[-1] if inverse else np.fft.fft(series)

        whole = ends[-1] - starts[0] == size.sum() and (size == size[0]).all()
        if whole and (at[starts[0]:ends[-1]].reshape(len(size), -1) == np.arange(size[0])).all():
            # Full groups of one length: all at once.
            out = spectrum(values[starts[0]:ends[-1]].reshape(len(size), -1)).ravel()
        else:
            spectra = []
            for start, end, length in zip(starts, ends, size):
                series = np.zeros(length, dtype=complex)
                series[at[start:end]] = values[start:end]
                spectra.append(spectrum(series))
            out = np.concatenate(spectra)
        return pd.DataFrame({
            **{f: np.repeat(rows[f].to_numpy()[starts], size) for f in fields},
            frequency: np.concatenate([np.arange(length) for length in size]),
            "re": out.real, "im": out.imag,
        })

    schema = ", ".join(["recording_id string", *(f"{c} bigint" for c in carried), f"{frequency} bigint, re double, im double"])
    return map_groups(df.select(*fields, position, "_len", "re", "im"), keys, position, transform, schema)


class Lengths(NamedTuple):
    """Which kinds of series longer than one group there are, as the number of passes over a grid (0: none)."""

    grid: int
    chirp: int


def survey_lengths(per_recording: DataFrame, group_rows: int = GROUP_ROWS) -> Lengths:
    """Look at the lengths ``n`` (one small aggregate) to know which transforms are needed."""
    n, passes = F.col("n"), _passes(F.col("n"), group_rows)
    row = per_recording.agg(
        F.max(F.when(passes > 1, passes)), F.max(F.when(passes.isNull(), _passes(_padded(n), group_rows)))
    ).first()
    return Lengths(row[0] or 0, row[1] or 0)


def _padded(n: Column) -> Column:
    """Power-of-two length for the chirp convolution of n values."""
    return next_pow2((2 * n - 1).cast("double"))


def _split(n: Column) -> Column:
    """A power of two near the root that divides n: the first side of its grid."""
    return F.least(n.bitwiseAND(-n), next_pow2(F.sqrt(n.cast("double"))))


def _passes(n: Column, group_rows: int) -> Column:
    """Sides of the smallest grid with none above ``group_rows``: 1 for a short series.

    More than two sides have the largest power of two that a group holds, as often as needed.
    NULL if n has too few factors of two. Cheap enough to be worked out per row.
    """
    bits = max(group_rows.bit_length() - 1, 1)
    shifts = F.array(*[F.lit(shift) for shift in range(0, 62, bits)][:SIDES - 1])

    def fits(m: Column, shift: Column) -> Column:
        rest = F.call_function("shiftright", m, shift)
        first = _split(rest)
        whole = F.call_function("shiftleft", rest, shift) == m
        return whole & (rest > 1) & (first <= group_rows) & (rest <= first * group_rows)

    def counted(m: Column) -> Column:
        found = F.array_position(F.transform(shifts, lambda shift: fits(m, shift)), F.lit(True))
        return F.when(m <= group_rows, 1).when(found > 0, found + 1)

    # Bound as a variable, so that n is worked out once.
    return F.transform(F.array(n), counted)[0].cast("int")


def _fft_short(series: DataFrame, inverse: bool) -> DataFrame:
    whole = series.withColumn("_len", F.col("n"))
    return _transform_groups(whole, ["recording_id"], ["n"], "j", "k", inverse).select(*_BINS)


def _fft_grid(series: DataFrame, outer: list[str], inverse: bool, group_rows: int, passes: int) -> DataFrame:
    """Series of ``passes`` sides, as a grid: its long columns first, themselves grids if need be, then its rows."""
    side, part, whole = f"_side{passes}", f"_part{passes}", f"_whole{passes}"
    first = _split(F.col("n")) if passes == 2 else F.lit(1 << (group_rows.bit_length() - 1)).cast("bigint")
    grid = series.withColumn(side, first).select(
        "recording_id", *outer, F.col("n").alias(whole), side, F.pmod(F.col("j"), F.col(side)).alias(part), F.expr(f"n div {side}").alias("n"),
        F.expr(f"j div {side}").alias("j"), "re", "im",
    )
    inside = [*outer, whole, side, part]
    if passes == 2:
        cols = _transform_groups(grid.withColumn("_len", F.col("n")), ["recording_id", *inside], [*inside, "n"], "j", "k", inverse)
    else:
        cols = _fft_grid(grid, inside, inverse, group_rows, passes - 1)
    turn = (1 if inverse else -1) * _angle(F.col(part), F.col("k"), F.col(whole))
    turned = cols.select(
        "recording_id", *outer, whole, side, F.col(part).alias("_row"), F.col("k").alias(part), F.col(side).alias("_len"),
        *_rotated(F.col("re"), F.col("im"), turn),
    )
    rows = _transform_groups(turned, ["recording_id", *inside], inside, "_row", "_high", inverse)
    k = F.col(part) + F.expr(f"{whole} div {side}") * F.col("_high")
    return rows.select("recording_id", *outer, F.col(whole).alias("n"), k.alias("k"), "re", "im")


def _rotated(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """Real and imaginary part after a turn by ``angle``."""
    return (
        (re * F.cos(angle) - im * F.sin(angle)).alias("re"),
        (re * F.sin(angle) + im * F.cos(angle)).alias("im"),
    )


def _square_mod(j: Column, m: Column) -> Column:
    """``j * j`` modulo ``m``, from the halves of j, so that no product leaves 64 bits below 2^52."""
    high, low = F.shiftright(j, 26), j.bitwiseAND((1 << 26) - 1)
    square = F.lit(0).cast("bigint")
    for part, shifts in ((high * high, (10, 10, 10, 10, 10, 2)), (2 * high * low, (10, 10, 6)), (low * low, ())):
        part = F.pmod(part, m)
        for shift in shifts:
            part = F.pmod(part * (1 << shift), m)
        square = square + part
    return F.pmod(square, m)


def _fft_chirp(series: DataFrame, inverse: bool, group_rows: int, passes: int) -> DataFrame:
    """All bins of series of any length, as a convolution with a chirp.

    ``2jk = j^2 + k^2 - (k-j)^2`` turns the sum into a convolution, which is done with
    transforms of a power-of-two length of at least 2n - 1, which factors evenly. The chirp
    depends on the length alone: it is made and transformed once for each that occurs, and
    joined on length and bin. The padded lengths are grids of ``passes`` sides.
    """
    sign = 1 if inverse else -1

    def chirp(position: str) -> Column:
        turns = 2 * F.col("size")
        return sign * 2 * F.pi() * _square_mod(F.col(position), turns) / turns

    sized = series.withColumn("size", F.col("n")).withColumn("n", _padded(F.col("n")))
    turned = sized.select("recording_id", "size", "n", "j", *_rotated(F.col("re"), F.col("im"), chirp("j")))
    each = series.select(F.col("n").alias("size")).distinct().withColumns({
        "n": _padded(F.col("size")), "_first": F.lit(0).cast("bigint"), "_last": F.col("size") - 1,
    })
    ends = F.when(F.col("m") == 0, F.array(F.col("m"))).otherwise(F.array(F.col("m"), F.col("n") - F.col("m")))
    kernel = explode_range(each, "_first", "_last", "m", spread_by=["size"]).select(
        F.col("size").cast("string").alias("recording_id"), "size", "n", F.cos(chirp("m")).alias("re"), (-F.sin(chirp("m"))).alias("im"), F.explode(ends).alias("j"),
    )
    left = _fft_grid(turned, ["size"], False, group_rows, passes)
    right = _fft_grid(kernel, ["size"], False, group_rows, passes).select("size", "k", F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = left.join(right, ["size", "k"]).select(
        "recording_id", "size", "n", F.col("k").alias("j"),
        ((F.col("re") * F.col("_re") - F.col("im") * F.col("_im")) / F.col("n")).alias("re"),
        ((F.col("re") * F.col("_im") + F.col("im") * F.col("_re")) / F.col("n")).alias("im"),
    )
    convolved = _fft_grid(product, ["size"], True, group_rows, passes).where(F.col("k") < F.col("size"))
    return convolved.select("recording_id", F.col("size").alias("n"), "k", *_rotated(F.col("re"), F.col("im"), chirp("k")))


def fft(series: DataFrame, kinds: Lengths, inverse: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All bins of each series ``(recording_id, n, j, re, im)`` as ``(recording_id, n, k, re, im)``.

    Unscaled both ways. No group is longer than ``group_rows``. A series up to that length
    is one group. A longer one is arranged as an ``n1 x n2`` grid with ``n = n1 * n2`` and n1
    a power of two: the columns are transformed, turned by their twiddle angle, then the
    rows are transformed; columns that are too long are grids themselves. Other lengths go
    through a chirp convolution of a length that is a grid. Lengths below 2^51 are exact in
    their angles.
    """
    if not (kinds.grid or kinds.chirp):
        return _fft_short(series, inverse)
    # Several branches read the series: write it once.
    scratch_root(series.sparkSession)
    series = series.withColumn("_passes", _passes(F.col("n"), group_rows)).checkpoint()
    passes = F.col("_passes")
    out = _fft_short(series.where(passes == 1), inverse)
    for count in range(2, kinds.grid + 1):
        out = out.unionByName(_fft_grid(series.where(passes == count).drop("_passes"), [], inverse, group_rows, count))
    for count in range(2, kinds.chirp + 1):
        fits = passes.isNull() & (F.lit(True) if kinds.chirp == 2 else _passes(_padded(F.col("n")), group_rows) == count)
        out = out.unionByName(_fft_chirp(series.where(fits).drop("_passes"), inverse, group_rows, count))
    return out


def dft_fast(
    signal: DataFrame, value: str = "v", size: int = CHUNK, group_rows: int = GROUP_ROWS, kinds: Lengths | None = None,
    flat_as_nan: bool = False,
) -> DataFrame:
    """All bins k = 0..n-1 of each recording; the same figures as :func:`dft`.

    ``kinds`` comes from :func:`survey_lengths` and is looked up (a job) if it is not given. With
    ``flat_as_nan`` a recording of one value has NaN in every bin.
    """
    base = signal.select("recording_id", "idx", F.col(value).cast("double").alias("re"))
    kinds = kinds or survey_lengths(lengths(base), group_rows)
    re = F.col("re")
    if flat_as_nan:
        per_recording = base.groupBy("recording_id").agg(F.max("idx").alias("n"), (F.min("re") == F.max("re")).alias("_flat"))
        re = F.when(F.col("_flat"), float("nan")).otherwise(re)
    else:
        per_recording = lengths(base)
    series = attach(with_chunk(base, size), per_recording, size).select(
        "recording_id", "n", (F.col("idx") - 1).alias("j"), re.alias("re"), F.lit(0.0).alias("im")
    )
    return unkeyed(fft(series, kinds, group_rows=group_rows))


def idft(spectrum: DataFrame, group_rows: int = GROUP_ROWS, kinds: Lengths | None = None) -> DataFrame:
    """Inverse transform of full spectra, real part, scaled by 1/n: ``(recording_id, idx, v)``."""
    series = keyed(spectrum.select("recording_id", "n", F.col("k").alias("j"), "re", "im"))
    kinds = kinds or survey_lengths(series.select("n"), group_rows)
    return unkeyed(fft(series, kinds, inverse=True, group_rows=group_rows)).select(
        "recording_id", (F.col("k") + 1).alias("idx"), (F.col("re") / F.col("n")).alias("v")
    )
