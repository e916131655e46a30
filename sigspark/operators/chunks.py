"""Cutting recordings into chunks, so that no task ever holds a whole recording.

A recording may hold a third of all rows. Every ordered operator therefore works on
``(recording_id, chunk)`` with ``chunk = (idx - 1) div size``:

* bounded frames (neighbours, +-d samples) copy the few rows around each chunk edge to
  the neighbouring chunk (:func:`with_halo`) and drop the copies afterwards;
* unbounded frames (running sums, last value so far) summarise each chunk to one row and
  carry the summary forward (:func:`carried`);
* whole-recording figures (length, extent) are joined on ``(recording_id, chunk)`` after
  spreading one row per recording over its chunks (:func:`attach`).

All three shuffle the signal once, on the same key, so chained operators share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 65_536
KEY = ("recording_id", "chunk")
# Stand for a recording without a name between cutting and the result, so that its rows
# keep their key in joins as they do in windows.
NAMELESS = {"string": "\0", "bigint": -(1 << 63), "int": -(1 << 31)}


def chunk_of(size: int = CHUNK, idx: str = "idx") -> Column:
    return F.expr(f"({idx} - 1) div {size}")


def _nameless(df: DataFrame) -> Column | None:
    kind = df.schema["recording_id"].dataType.simpleString()
    return F.lit(NAMELESS[kind]).cast(kind) if kind in NAMELESS else None


def keyed(df: DataFrame) -> DataFrame:
    name = _nameless(df)
    return df if name is None else df.withColumn("recording_id", F.coalesce("recording_id", name))


def unkeyed(df: DataFrame) -> DataFrame:
    name = _nameless(df)
    return df if name is None else df.withColumn("recording_id", F.nullif(F.col("recording_id"), name))


def with_chunk(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``chunk`` and key nameless recordings; :func:`unkeyed` undoes the latter."""
    return keyed(df).withColumn("chunk", chunk_of(size))


def with_halo(df: DataFrame, before: int | str, after: int | str, size: int = CHUNK) -> DataFrame:
    """Add ``chunk``; rows needed by another chunk's frame appear there once more.

    ``before``/``after`` is how many rows a frame reaches back/ahead, the same for all rows or
    the name of a column that has each row's own.
    """
    first = F.expr(f"greatest(0L, (idx - 1 - {after}) div {size})")
    last = F.expr(f"(idx - 1 + {before}) div {size}")
    return keyed(df).withColumn("chunk", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Drop the copies again."""
    return df.where(F.col("chunk") == chunk_of(size))


def chunk_window(*order: str) -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(*(order or ("idx",)))


def explode_range(
    df: DataFrame, first: str, last: str, name: str, block: int = CHUNK, spread_by: list[str] | None = None
) -> DataFrame:
    """One row per whole number from column ``first`` to column ``last``, none if empty.

    The range is cut into blocks first, so one very long range is never a single array.
    With ``spread_by`` (columns that tell the rows apart) the blocks go to different tasks
    before they are filled; the partition count is given so that they are not merged again
    for being small.
    """
    blocks = df.where(F.col(first) <= F.col(last)).withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, ({last} - {first}) div {block})"))
    )
    if spread_by:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(tasks, *spread_by, "_block")
    lo = F.expr(f"{first} + _block * {block}")
    hi = F.expr(f"least({last}, {first} + _block * {block} + {block - 1})")
    return blocks.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_block")


def attach(df: DataFrame, per_recording: DataFrame, size: int = CHUNK, n: str = "n") -> DataFrame:
    """Join one row per recording to chunked rows.

    ``per_recording`` has ``recording_id`` and the recording's length ``n``; it is spread
    to one row per chunk, so a hot recording's rows are joined in as many tasks as it has
    chunks. ``df`` must already carry ``chunk``.
    """
    spread = keyed(per_recording).withColumn("_last", F.expr(f"({n} - 1) div {size}")).withColumn("_zero", F.lit(0).cast("bigint"))
    spread = explode_range(spread, "_zero", "_last", "chunk").drop("_zero", "_last")
    return df.join(spread, list(KEY))


def lengths(df: DataFrame) -> DataFrame:
    """Rows per recording, for dense indexes."""
    return df.groupBy("recording_id").agg(F.max("idx").alias("n"))


def carried(df: DataFrame, summaries: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """What earlier chunks of the recording hand over to each chunk: one row per chunk.

    ``summaries`` are aggregates over one chunk; ``carries`` are aggregates over the
    summaries of all earlier chunks. ``df`` must carry ``chunk``. Join the result on
    ``KEY`` after the windows over the chunk, whose partitioning and order it then shares.
    """
    per_chunk = df.groupBy(*KEY).agg(*[c.alias(name) for name, c in summaries.items()])
    earlier = (
        Window.partitionBy("recording_id").orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_chunk.select(*KEY, *[c.over(earlier).alias(name) for name, c in carries.items()])
