"""Line pieces from a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigspark.operators.chunks import CHUNK, unkeyed, with_halo
from sigspark.sources.scratch import scratch_path

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "recording_id string, idx bigint, t0 double, v0 double, t1 double, v1 double"


# Chunks are dealt into so many groups; a group takes its samples so many at a time.
GROUPS = 512
PORTION_ROWS = 1 << 19
_PLACE = ["recording_id", "chunk", "idx"]


class SegmentProcessor(StatefulProcessor):
    """Join each sample of a group of chunks to the one before it, in whatever order they arrive.

    State holds the samples still waiting for a neighbour: normally the last one of a recording only.
    """

    def __init__(self, size: int, portion_rows: int = PORTION_ROWS):
        self._size, self._portion_rows = size, portion_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._waiting = handle.getMapState(
            "waiting", "recording_id string, chunk bigint, idx bigint", "t double, v double, has_prev boolean, has_next boolean"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for some in rows:
            held.append(some)
            n += len(some)
            if n >= self._portion_rows:
                yield from self._pieces(pd.concat(held))
                held, n = [], 0
        if n:
            yield from self._pieces(pd.concat(held))

    def _pieces(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf[[*_PLACE, "t", "v"]].drop_duplicates(_PLACE).sort_values(_PLACE, ignore_index=True)
        pdf["kept"] = False
        # The first own sample of a recording and a copy from the previous chunk need no predecessor.
        pdf["has_prev"] = (pdf["idx"] == 1) | (pdf["idx"] <= pdf["chunk"] * self._size)
        pdf["has_next"] = pdf["idx"] >= (pdf["chunk"] + 1) * self._size
        fresh_starts = pdf.loc[(pdf["idx"] == 1) & (pdf["chunk"] == 0), ["recording_id", "idx", "t", "v"]]

        follows = self._follows(pdf)
        before = pdf.loc[~follows & ~pdf["has_prev"], _PLACE].assign(idx=lambda gap: gap["idx"] - 1)
        after = pdf.loc[~follows.shift(-1, fill_value=False) & ~pdf["has_next"], _PLACE].assign(idx=lambda gap: gap["idx"] + 1)
        edges = pd.concat([before, after]).drop_duplicates().itertuples(index=False, name=None)
        kept = [(*place, *self._waiting.getValue(place)) for place in edges if self._waiting.containsKey(place)]
        if kept:
            old = pd.DataFrame(kept, columns=[*_PLACE, "t", "v", "has_prev", "has_next"])
            pdf = pd.concat([pdf, old.assign(kept=True)]).sort_values(_PLACE, ignore_index=True)
            follows = self._follows(pdf)

        joined = follows & ~pdf["has_prev"].astype(bool)
        pieces = pd.DataFrame({
            "recording_id": pdf["recording_id"], "idx": pdf["idx"],
            "t0": pdf["t"].shift(), "v0": pdf["v"].shift(), "t1": pdf["t"], "v1": pdf["v"],
        })[joined]
        starts = pd.DataFrame({
            "recording_id": fresh_starts["recording_id"], "idx": fresh_starts["idx"], "t0": None, "v0": None,
            "t1": fresh_starts["t"], "v1": fresh_starts["v"],
        }).astype({"t0": "float64", "v0": "float64"})
        yield starts
        yield pieces

        pdf["has_prev"] = pdf["has_prev"].astype(bool) | joined
        pdf["has_next"] = pdf["has_next"].astype(bool) | follows.shift(-1, fill_value=False)
        # Nearly all samples have both neighbours by now and are none of the state's business.
        finished = pdf["has_prev"] & pdf["has_next"]
        for row in pdf[~finished].itertuples():
            self._waiting.updateValue(
                (row.recording_id, int(row.chunk), int(row.idx)), (float(row.t), float(row.v), bool(row.has_prev), bool(row.has_next))
            )
        for place in pdf.loc[finished & pdf["kept"].astype(bool), _PLACE].itertuples(index=False, name=None):
            self._waiting.removeKey(place)

    @staticmethod
    def _follows(pdf: pd.DataFrame) -> pd.Series:
        """Which samples come right after the one in the row before, in the same chunk of the same recording."""
        same = (pdf["recording_id"] == pdf["recording_id"].shift()) & (pdf["chunk"] == pdf["chunk"].shift())
        return same & (pdf["idx"].diff() == 1)

    def close(self) -> None:
        pass


def stream_segments(stream: DataFrame, size: int = CHUNK, path: str | None = None) -> DataFrame:
    """Previous-to-current pieces of a stream ``(recording_id, idx, t, v)``, run to its present end.

    Chunks, not recordings, are dealt into ``GROUPS`` groups, so a hot recording spreads over tasks and
    short ones are taken many at a time; the last sample of a chunk also goes to the next one. State
    is kept per sample that waits for a neighbour.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "segments")
    pieces = (
        with_halo(stream.select("recording_id", "idx", "t", "v"), 1, 0, size)
        .withColumn("group", F.pmod(F.xxhash64("recording_id", "chunk"), F.lit(GROUPS)).cast("int"))
        .groupBy("group")
        .transformWithStateInPandas(SegmentProcessor(size), _OUT, "append", "none")
    )
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (
            pieces.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", f"{path}/state").option("path", f"{path}/pieces")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return unkeyed(spark.read.schema(_OUT).parquet(f"{path}/pieces"))
