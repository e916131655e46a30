"""Removal of word runs that repeat anywhere: a count-min sketch first, exact grouping of what it lets through."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import MUL, covered, mix, run_hashes, word_hashes, words_of

#: The sketch: DEPTH rows of CELLS cells, in blocks that are merged apart.
DEPTH, CELLS, BLOCK = 2, 1 << 26, 1 << 20
#: Cells a task gathers before it hands on a partial sketch.
GATHER = 1 << 22


def anchors(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``gram``-word run, and for each window of ``size`` words the run in it with the smallest.

    Equal windows have equal anchors at equal distances, so an anchor is selected in at least
    as many places as its window occurs in: the count of anchors overestimates that of windows.
    """
    grams = run_hashes(hashes, gram)
    if len(hashes) < size:
        return grams, np.empty(0, np.int64)
    width = size - gram + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return grams, best + np.arange(len(best))


def _cells(grams: np.ndarray) -> np.ndarray:
    """The cell of each run in each row of the sketch, rows one after the other."""
    return np.stack([(mix(grams + np.uint64(row) * MUL) % np.uint64(CELLS)) + np.uint64(row * CELLS) for row in range(DEPTH)])


def _partial(cells: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of one task by block: places in the block, the top bit set where the count is above one."""
    place, count = np.unique(np.concatenate(cells), return_counts=True)
    block, start = np.unique(place // BLOCK, return_index=True)
    packed = ((place % BLOCK).astype(np.uint32) | (count > 1).astype(np.uint32) << np.uint32(31))
    return pa.RecordBatch.from_arrays(
        [pa.array(block.astype(np.int32)), pa.array([x.tobytes() for x in np.split(packed, start[1:])], pa.binary())], ["block", "counts"]
    )


def _counter(select):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                picked = select(text)
                if len(picked):
                    held.append(_cells(picked).ravel())
                    n += len(held[-1])
                if n > GATHER:
                    yield _partial(held)
                    held, n = [], 0
        if n:
            yield _partial(held)

    return count


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches in the order of blocks to a bitmap per block: whether a cell counts two or more."""
    now, seen, twice = None, None, None
    for batch in itertools.chain(batches, [None]):
        done = []
        rows = [(None, b"")] if batch is None else zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist())
        for block, counts in rows:
            if block != now:
                if now is not None:
                    done.append((now, np.packbits(twice, bitorder="little").tobytes()))
                now, seen, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
            if block is None:
                break
            part = np.frombuffer(counts, np.uint32)
            place = part & np.uint32(BLOCK - 1)
            twice[place] |= seen[place] | (part >> np.uint32(31)).astype(bool)
            seen[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], ["block", "bits"])


def sketch(texts: DataFrame, select) -> np.ndarray:
    """The merged sketch as bits: a fixed 2 * 8 MB, whatever the input.

    ``select`` gives the hashes of a text that are counted.
    """
    parts = texts.mapInArrow(_counter(select), "block int, counts binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    bits = np.zeros(DEPTH * CELLS // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def let_through(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates each hash to occur more than once."""
    cells = _cells(hashes).astype(np.int64)
    return ((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=0)


def _anchors_of(size: int, gram: int):
    def select(text: str | None) -> np.ndarray:
        grams, at = anchors(word_hashes(words_of(text)), size, gram)
        return grams[np.unique(at)]

    return select


def _flagged(hashes: np.ndarray, bits: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Starts of the windows that the sketch estimates to occur more than once."""
    grams, at = anchors(hashes, size, gram)
    if not len(at):
        return at
    picked, back = np.unique(at, return_inverse=True)
    return np.flatnonzero(let_through(grams[picked], bits)[back])


def _window_hashes(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of every window."""
    return run_hashes(hashes, size), (run_hashes(mix(hashes), size) >> np.uint64(32)).astype(np.int64)


def _emitter(bits, size: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, ref, pos = [], [], [], []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("ref").to_pylist()):
                hashes = word_hashes(words_of(text))
                start = _flagged(hashes, bits.value, size, gram)
                if len(start):
                    a, b = _window_hashes(hashes, size)
                    one.append(a[start])
                    two.append(b[start])
                    ref.append(np.full(len(start), key))
                    pos.append(start)
            if one:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).astype(np.uint32).view(np.int32)),
                        pa.array(np.concatenate(ref)), pa.array(np.concatenate(pos).astype(np.int32)),
                    ],
                    ["h", "h2", "ref", "pos"],
                )

    return emit


def _remover(bits, size: int, gram: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, pos, hashed in zip(batch.column("text").to_pylist(), batch.column("pos").to_pylist(), batch.column("h").to_pylist()):
                words = words_of(text)
                hashes = word_hashes(words)
                start = _flagged(hashes, bits.value, size, gram)
                if pos and len(start):
                    # Windows that the sketch let through but the exact count found once.
                    single = np.array(pos, np.int64)
                    same = run_hashes(hashes, size)[np.minimum(single, len(hashes) - size)] == np.array(hashed, np.int64).view(np.uint64)
                    start = np.setdiff1d(start, single[same])
                drop = covered(start, size, len(words)) if len(start) else np.zeros(len(words), bool)
                n_words.append(len(words))
                n_removed.append(int(drop.sum()))
                kept.append(b" ".join(itertools.compress(words, ~drop)) if len(start) else b" ".join(words))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], ["row", "n_words", "n_removed", "kept"]
            )

    return remove


def without_repeats(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), size: int = 35, gram: int = 16) -> DataFrame:
    """``(row, n_words, n_removed, kept)`` per row of ``docs``; ``row`` holds the ``carry`` columns.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. Every word covered by a
    window of ``size`` words that also starts anywhere else, in the same or another row, is
    removed; ``kept`` has the others, joined by one space. All windows are judged on the input.
    Repeated rows are copies of each other. A null, empty or shorter text keeps its words.

    Three passes over the texts: tasks count anchors in partial sketches, which are merged
    block by block; windows whose anchor may occur twice are grouped on 96 bits of hash, with
    counts combined before the shuffle, so a window in a third of all documents is one row a
    task; the windows that turn out to occur once go back to their texts and are let off.
    A sketch that fills up at a larger input lets more through and loses none. Runs one job.
    """
    session = docs.sparkSession
    ref = F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    texts = docs.select(F.col(text_col).alias("text"), ref.alias("ref"))
    bits = session.sparkContext.broadcast(sketch(texts.select("text"), _anchors_of(size, gram)))
    emitted = texts.mapInArrow(_emitter(bits, size, gram), "h long, h2 int, ref long, pos int")
    single = (
        emitted.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("ref").alias("ref"), F.min("pos").alias("pos"))
        .filter("n = 1").groupBy("ref").agg(F.collect_list("pos").alias("pos"), F.collect_list("h").alias("h"))
    )
    whole = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"), ref.alias("ref"))
    fields = whole.schema["row"].dataType.simpleString()
    return whole.join(single, "ref", "left").select("row", "text", "pos", "h").mapInArrow(
        _remover(bits, size, gram), f"row {fields}, n_words long, n_removed long, kept string"
    )
