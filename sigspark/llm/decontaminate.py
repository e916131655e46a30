"""Benchmark decontamination: shared seeds by a join, coverage by greedy string tiling."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import run_hashes, stored, text_key, word_hashes

#: Cells of the bitmap of benchmark seeds, and of one block of it.
CELLS, BLOCK = 1 << 24, 1 << 16
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(None, _SIGNS).split()


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes: ``(doc place, item place, length)`` of each tile.

    Karp-Rabin hashes of every run of ``least`` words give the seeds, seeds in a row the
    longest matches. The longest match left is marked first (ties: earliest in the item, then
    in the document); what marks leave of a match comes up again by its new length.
    """
    places = defaultdict(list)
    for i, h in enumerate(run_hashes(item, least).tolist()):
        places[h].append(i)
    grams = run_hashes(doc, least)
    wanted = np.flatnonzero(np.isin(grams, np.fromiter(places, np.uint64, len(places))))
    pairs = {(j, i) for j in wanted.tolist() for i in places[int(grams[j])]}
    heap = []
    for j, i in pairs:
        if (j - 1, i - 1) not in pairs:
            n = 1
            while (j + n, i + n) in pairs:
                n += 1
            heap.append((-(n + least - 1), i, j))
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        taken = in_doc[j : j - n] | in_item[i : i - n]
        if not taken.any():
            in_doc[j : j - n] = in_item[i : i - n] = True
            out.append((j, i, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # stretches that are free in both
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _seeder(least: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = plain_words(text)
                grams = run_hashes(word_hashes(words), least).view(np.int64).tolist()
                out[0].extend(grams)
                out[1].extend([item] * len(grams))
                out[2].extend([len(words)] * len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["seed", "item_id", "item_words"])

    return seed


def _painter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        cells = batch.column("seed").to_numpy().view(np.uint64) % np.uint64(CELLS)
        for block in np.unique(cells // BLOCK).tolist():
            bits = blocks.setdefault(int(block), np.zeros(BLOCK, bool))
            bits[(cells[cells // BLOCK == block] % np.uint64(BLOCK)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(blocks), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"]
    )


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Cells that some seed falls into: 2 MB however large the benchmark."""
    out = np.zeros(CELLS // 8, np.uint8)
    for row in seeds.select("seed").mapInArrow(_painter, "block int, bits binary").toLocalIterator():
        at = row["block"] * (BLOCK // 8)
        out[at : at + BLOCK // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _matcher(bits, least: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seeds = [], []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                grams = run_hashes(word_hashes(plain_words(text)), least)
                cells = (grams % np.uint64(CELLS)).astype(np.int64)
                hit = np.unique(grams[((bits.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)])
                keys.extend([key] * len(hit))
                seeds.extend(hit.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(seeds, pa.int64())], ["text_key", "seed"])

    return match


def _tiler(least: int, percent: int):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, items in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "items"))):
                doc = word_hashes(plain_words(text))
                for one in items:
                    item = word_hashes(plain_words(one["text"]))
                    found = tiles(doc, item, least)
                    covered = sum(t[2] for t in found)
                    if 100 * covered >= percent * len(item):
                        for column, value in zip(out, (key, one["item_id"], len(item), covered, len(found))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), *[pa.array(v, pa.int64()) for v in out[1:]]], ["text_key", "item_id", "item_words", "covered_words", "tiles"]
            )

    return tile


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = 5, percent: int = 50) -> DataFrame:
    """``(text_key, item_id, item_words, covered_words, tiles)`` for each text and benchmark item in it.

    An item is in a text if greedy string tiling with tiles of ``least`` words or more covers
    ``percent`` per cent of the item's words, in whatever order. Texts are named by
    ``text_key``, so copies are tiled once. Seeds (runs of ``least`` words) of all texts pass a
    fixed bitmap of the benchmark's seeds and join these by hash; a pair goes on if its shared
    seeds could cover enough. All pairs a text shares seeds with are kept, however many.

    Null and shorter texts and items share nothing. Repeated items (same id and text) count
    once; items that share an id are judged one by one, each giving a row. Runs one job.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item_key", text_key(F.col("text")))
    seeds = stored(items.select("item_id", "text").mapInArrow(_seeder(least), "seed long, item_id long, item_words long"), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(seeds))
    texts = docs.select(F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    shared = texts.mapInArrow(_matcher(bits, least), "text_key binary, seed long").distinct()
    pairs = (
        shared.join(seeds, "seed").groupBy("text_key", "item_id", "item_words").agg(F.count("*").alias("n"))
        .filter(f"100 * {least} * n >= {percent} * item_words").select("text_key", "item_id").distinct()
    )
    wanted = stored(
        pairs.join(items, pairs["item_id"].eqNullSafe(items["item_id"])).groupBy("text_key").agg(
            F.collect_list(F.struct(items["item_id"], "text")).alias("items")
        ), "wanted",
    )
    one_each = texts.join(wanted.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
    return one_each.join(wanted, "text_key").select("text_key", "text", "items").mapInArrow(
        _tiler(least, percent), "text_key binary, item_id long, item_words long, covered_words long, tiles long"
    )


def leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """``(row, item_id, item_words, covered_words, tiles)`` per row of ``docs`` and item in it; ``row`` holds its columns."""
    found = leaks(docs, benchmark, text_col, **settings)
    whole = docs.select(F.struct("*").alias("row"), text_key(F.col(text_col)).alias("text_key"))
    return whole.join(found, "text_key").drop("text_key")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    found = leaks(docs, benchmark, text_col, **settings).select("text_key").distinct()
    whole = docs.select(F.struct("*").alias("row"), text_key(F.col(text_col)).alias("text_key"))
    return whole.join(found, "text_key", "left_anti").select("row.*")
