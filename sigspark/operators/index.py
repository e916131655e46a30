"""Position numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.clock import number_axis
from sigspark.sources.scratch import scratch_root

# A key with more rows than this is cut into pieces of about this many.
PIECE_ROWS = 1 << 20
# A hot key is cut at so many quantiles of its order column, then evenly between them.
CELLS = 64
FINENESS = 4
# Hot keys up to this number go to every task; beyond, Spark joins as it sees fit.
SHORT_TABLE = 10_000


def _cell(axis: Column) -> Column:
    """How many of the quantiles ``_borders`` lie below the axis, found in two short steps."""
    step = int(CELLS ** 0.5)
    below = lambda borders: F.size(F.filter(borders, lambda b: b < axis))
    coarse = F.transform(F.sequence(F.lit(step), F.lit(CELLS - 1), F.lit(step)), lambda k: F.col("_borders")[k - 1])
    first = below(coarse) * step
    return first + below(F.slice("_borders", first + 1, step))


def hot_keys(df: DataFrame, keys: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame | None:
    """Keys with more than ``piece_rows`` rows and their counts ``_n``; None if there are none.

    A plain count, run when it is asked for: at most one key in ``piece_rows`` rows is hot, so what
    comes back is small and is kept under the checkpoint folder.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece_rows)
    if hot.isEmpty():
        return None
    scratch_root(df.sparkSession)
    return hot.checkpoint()


def _joined(df: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe join with the table of hot keys; it goes to every task if it is counted to be short."""
    few = few.withColumnsRenamed({c: f"_hot_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    few = F.broadcast(few) if few.count() <= SHORT_TABLE else few
    return df.join(few, same, how).drop(*[f"_hot_{c}" for c in keys])


def cut_keys(
    df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS, cut_along: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Add piece numbers that cut hot keys along their order columns; also the new columns' names.

    A plain count finds the hot keys; only for their rows a quantile sketch of the first order
    column is made. A hot key is cut at these quantiles, so an outlier, a gap or a burst moves no
    other rows together, and each cell again into even stretches. Rows without an order value
    come first, NaN last, in pieces of their own. ``cut_along`` lists the order columns to cut by,
    one cut inside the other: by default the first one. Name a later order column to cut rows
    that agree in the earlier ones, as in a burst of one instant or rows without a value. Keys
    are compared null-safe. ``_cut`` tells the rows of keys that were cut.
    """
    pieces: list[str] = []
    df = df.withColumn("_cut", F.lit(False))
    for level, column in enumerate(cut_along or order[:1]):
        group, piece = [*keys, *pieces], f"_piece{level}"
        pieces.append(piece)
        counted = hot_keys(df, group, piece_rows)
        if counted is None:
            df = df.withColumn(piece, F.lit(0).cast("bigint"))
            continue
        axis = number_axis(df, column).cast("double")
        finite = F.when(~F.isnan(axis) & (F.abs(axis) < float("inf")), axis)
        # A later order column only orders rows that agree in all earlier ones.
        agree = F.lit(True)
        for earlier in order[:order.index(column)]:
            none = F.count(earlier) == 0
            agree = agree & (none | ((F.min(earlier) == F.max(earlier)) & (F.count(earlier) == F.count(F.lit(1)))))
        marks = [k / CELLS for k in range(1, CELLS)]
        hot = _joined(df, counted, group, "inner").groupBy(*group).agg(
            F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"),
            F.percentile_approx(finite, marks, 1000).alias("_borders"), agree.alias("_agree"),
        ).where("_agree").select(
            *group, "_lo", "_hi", "_borders", F.ceil(F.col("_n") * FINENESS / (piece_rows * CELLS)).alias("_cuts"), F.lit(True).alias("_is_hot"),
        ).checkpoint()
        cell = _cell(finite)
        lo = F.when(cell > 0, F.element_at("_borders", F.greatest(cell, F.lit(1)))).otherwise(F.col("_lo"))
        hi = F.when(cell < CELLS - 1, F.element_at("_borders", F.least(cell + 1, F.lit(CELLS - 1)))).otherwise(F.col("_hi"))
        inside = F.least(F.floor(F.try_divide(finite - lo, hi - lo) * F.col("_cuts")), F.col("_cuts") - 1)
        place = F.when(axis.isNull() | (axis == float("-inf")), F.when(axis.isNull(), F.lit(-2)).otherwise(F.lit(-1))).when(
            finite.isNull(), F.when(F.isnan(axis), CELLS * F.col("_cuts") + 1).otherwise(CELLS * F.col("_cuts"))
        ).otherwise(cell * F.col("_cuts") + F.coalesce(inside, F.lit(0)))
        df = (
            _joined(df, hot, group, "left")
            .withColumn(piece, F.when(F.col("_is_hot"), place).otherwise(F.lit(0)).cast("bigint"))
            .withColumn("_cut", F.col("_cut") | F.coalesce("_is_hot", F.lit(False)))
            .drop("_lo", "_hi", "_borders", "_cuts", "_is_hot")
        )
    return df, pieces


def with_index(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "idx",
    piece_rows: int = PIECE_ROWS,
    cut_along: list[str] | None = None,
) -> DataFrame:
    """Number the rows of each key 1, 2, ... along ``order`` (which must be a total order).

    A plain count looks for hot keys first. Without any, every key is numbered in one window:
    the input is read twice, the first time only for its keys. A hot key is cut into pieces, see
    :func:`cut_keys`; rows are numbered inside a piece and shifted by the row count of the pieces
    before it: the input is then read four times, thrice for keys and order columns only.
    """
    if hot_keys(df, keys, piece_rows) is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    cut, pieces = cut_keys(df, keys, order, piece_rows, cut_along)
    before = Window.partitionBy(*keys).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.where(F.col("_cut"))
        .groupBy(*keys, *pieces).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*[F.col(c).alias(f"_s_{c}") for c in (*keys, *pieces)], F.sum("_rows").over(before).alias("_shift"))
    )
    same = F.lit(True)
    for c in (*keys, *pieces):
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    in_piece = F.row_number().over(Window.partitionBy(*keys, *pieces).orderBy(*order))
    return (
        cut.withColumn("_pos", in_piece)
        .join(shifts, same, "left")
        .withColumn(name, F.col("_pos") + F.coalesce("_shift", F.lit(0)))
        .select(*df.columns, name)
    )
