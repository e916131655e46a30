"""Documents packed into sequences of a fixed length: dominance reduction, then best fit.

A document is a size, and there are at most ``capacity`` sizes, so the packing is planned on how
many pieces have each size. Sets that dominate every other filling of their sequence are fixed
first (Martello and Toth: no packing is worse off with them), as often as their sizes allow;
what remains is packed best fit, sizes falling. A plan is a table of runs of equal places per
size, whatever the number of documents; pieces find theirs by their rank among equal sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import stored
from sigspark.llm.vocabulary import portions, word_ids

#: A sequence of the plan: how often it comes, and the sizes of its pieces in order.
Plan = list[tuple[int, list[int]]]
_FIELDS = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64()),
]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long"


def _times(counts: np.ndarray, sizes: list[int]) -> int:
    """How often the counts allow a set of sizes."""
    return min(int(counts[s]) // sizes.count(s) for s in set(sizes))


def _best_set(counts: np.ndarray, size: int, room: int) -> list[int] | None:
    """Up to two sizes that, next to ``size``, dominate all else that fits; None if nothing is proven.

    ``counts`` leaves out the piece of ``size`` itself. A set is dominated if its pieces can be
    dealt into groups no larger than different pieces of the other set.
    """
    fitting = np.flatnonzero(counts[: room + 1])
    if not len(fitting):
        return []
    largest = int(fitting[-1])
    if largest == room:
        return [largest]
    few = np.repeat(fitting[:3], np.minimum(counts[fitting[:3]], 3))[:3].tolist()
    if len(few) < 2 or few[0] + few[1] > room:
        return [largest]
    if len(few) == 3 and sum(few) <= room:
        return None
    # Two more pieces at most: the largest piece that goes with each as the smaller of the two.
    below = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
    partner = below[np.minimum(fitting, room - fitting)]
    twins = (partner == fitting) & (counts[fitting] < 2)
    partner[twins] = np.where(fitting[twins] > 0, below[np.maximum(fitting[twins] - 1, 0)], 0)
    pairs, smaller = (fitting + partner)[partner > 0], partner[partner > 0]
    if not len(pairs) or pairs.max() <= largest:
        return [largest]
    second = int(below[room - largest])
    if second == largest and counts[largest] < 2:
        second = int(below[largest - 1]) if largest else 0
    if second == 0:
        return None
    # Pairs whose smaller piece exceeds ``second`` must fit in place of the largest alone.
    others = fitting[fitting > second]
    if len(others):
        top = below[np.minimum(others, room - others)]
        lone = (top == others) & (counts[others] < 2)
        top[lone] = below[np.maximum(others[lone] - 1, 0)]
        if ((top > second) & (others + top > largest)).any():
            return None
    return [largest, second]


def reduced(counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """The sequences that some best packing has, and the counts of the sizes that are left."""
    left, plan, before = counts.copy(), [], None
    while before is None or before != left.tolist():
        before = left.tolist()
        for size in np.flatnonzero(left)[::-1].tolist():
            while left[size]:
                left[size] -= 1
                found = _best_set(left, size, capacity - size)
                left[size] += 1
                if found is None:
                    break
                chosen = [size, *found]
                times = _times(left, chosen)
                plan.append((times, chosen))
                for s in chosen:
                    left[s] -= times
    return plan, left


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Sizes falling, each piece into the open sequence with the least room that suffices.

    Pieces of one size fill sequences of one room alike, so they are placed together: the plan
    is the same as piece by piece.
    """
    rooms: dict[int, list[tuple[int, tuple]]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in [*sorted(r for r in rooms if r >= size), None]:
            if not left:
                break
            if room is None:
                each = capacity // size
                opened = [(left // each, ())] if left >= each else []
                opened += [(1, ())] if left % each else []
                space = capacity
            else:
                opened, space, each = rooms.pop(room), room, room // size
            kept = []
            for number, content in opened:
                full = min(number, left // each)
                if full:
                    rooms.setdefault(space - each * size, []).append((full, (*content, (size, each))))
                    left -= full * each
                if full < number and left:
                    rooms.setdefault(space - left * size, []).append((1, (*content, (size, left))))
                    full, left = full + 1, 0
                if full < number:
                    kept.append((number - full, content))
            if kept:
                rooms.setdefault(space, []).extend(kept)
    return [(number, [s for s, times in content for _ in range(times)]) for group in rooms.values() for number, content in group]


def plan_of(counts: np.ndarray, capacity: int) -> Plan:
    """The packing of ``counts[size]`` pieces of each size up to ``capacity``."""
    fixed, left = reduced(counts.astype(np.int64), capacity)
    return fixed + best_fit(left, capacity)


def _places(plan: Plan) -> tuple[np.ndarray, ...]:
    """Runs of equal places ``(key, first sequence, copies in a sequence, first offset)`` by size and rank.

    The key is ``size * 2^44 + rank`` of the run's first piece; the ranks of a size run through
    the sequences of its runs, one copy after the other.
    """
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for number, sizes in plan:
        offset = 0
        for size in dict.fromkeys(sizes):
            copies = sizes.count(size)
            rows.append((size * 2**44 + ranks.get(size, 0), sequence, copies, offset))
            ranks[size] = ranks.get(size, 0) + number * copies
            offset += copies * size
        sequence += number
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(found[:, k].copy() for k in range(4))


def _cutter(tokenizer: str, capacity: int, end: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, met = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in portions(batch):
                ids, counts = encoder.encode(some.column("text"))
                starts = np.concatenate([[0], np.cumsum(counts + 1)])
                whole = np.full(int(starts[-1]), end, "<u4")
                inside = np.ones(len(whole), bool)
                inside[starts[1:] - 1] = False
                whole[inside] = ids
                parts = -(-(counts + 1) // capacity)
                owner = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, (counts + 1)[owner] - start)
                at = starts[owner] + start
                raw = whole.tobytes()
                texts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                # The rank of a piece among those of its size that the task has cut so far.
                order = np.argsort(length, kind="stable")
                sizes, first, times = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, times) + np.repeat(met[sizes], times)
                met[sizes] += times
                columns = [
                    some.column("doc_id").take(pa.array(owner)), piece.astype(np.int32), start, length, np.array([zlib.crc32(x) for x in texts], np.int64),
                    texts if keep_ids else [None] * len(texts), np.full(len(owner), task, np.int32), nth,
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) if not isinstance(c, pa.Array) else c for c, (_, kind) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])

    return cut


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)`` of every piece of every row of ``docs``.

    A document is the ids of its text (null: none) and ``end``; longer ones are cut every
    ``capacity`` ids, so each row has a piece, repeated rows and rows without an id theirs. ``ids``
    (little-endian, 32 bits) are null unless asked for; ``sequences`` puts them together. Only
    ``doc_id`` and ``text`` are read, whatever else the columns are called. No rows: no pieces.

    Texts are encoded where they are read and do not move. A piece carries its rank among the
    pieces of its size that its task cut; counts per task and size turn this into a rank among
    all, and the driver plans on at most ``capacity`` counts. Which of the equal sizes goes where
    follows the order of the rows read; a written table keeps it, so a lost task changes nothing.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(read.mapInArrow(_cutter(tokenizer, capacity, end, keep_ids), _PIECES), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    places = docs.sparkSession.sparkContext.broadcast(_places(plan_of(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, copies, offsets = places.value
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            key = length * 2**44 + rank
            run = np.searchsorted(keys, key, side="right") - 1
            inside = key - keys[run]
            sequence, offset = first[run] + inside // copies[run], offsets[run] + inside % copies[run] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(sequence), pa.array(offset)],
                [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
            )

    ranked = pieces.join(shift, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("nth") + F.col("shift")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, spans)``: the ids of each sequence and which documents lie where.

    ``pieces`` come from ``packed(..., keep_ids=True)``; a sequence has at most ``capacity`` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"])).alias("spans"),
    )
