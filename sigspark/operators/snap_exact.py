"""Peak snapping by the step-by-step rule."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.chunks import CHUNK, KEY, keyed, own_rows, unkeyed, with_halo
from sigspark.operators.groups import map_groups
from sigspark.operators.windows import extreme_columns
from sigspark.sources.scratch import scratch_root

_OUT = "recording_id string, chunk bigint, idx bigint, code int, kind string"
_MOVES = "recording_id string, chunk bigint, state string, out array<int>"
#: Entry states of a chunk that are tried ahead of being needed, besides those of one mark.
STATES = 64


def _walk_chunk(first: int, last: int, marks: dict[int, int], to_max: np.ndarray, to_min: np.ndarray):
    """Visit the marks of positions first..last in order and move each to its place.

    Returns the marks that stay, those moved back over the start and those moved on over
    the end, each as position to code.
    """
    back, ahead = {}, {}
    queue = sorted(marks)
    while queue:
        i = heapq.heappop(queue)
        if i not in marks:
            continue
        target = int((to_max if marks[i] % 2 else to_min)[i - first])
        if target == i:
            continue
        side = back if target < first else ahead if target > last else marks
        side[target] = marks.pop(i)
        if i < target <= last:
            heapq.heappush(queue, target)
    return {"here": marks, "back": back, "ahead": ahead}


def _lets_through(first: int, last: int, d: int, to_max: np.ndarray, to_min: np.ndarray) -> bool:
    """Whether a mark on one of the first ``d`` positions can have an effect beyond the end, whatever its kind."""
    reached = set(range(first, min(first + d, last + 1)))
    queue = sorted(reached)
    while queue:
        i = heapq.heappop(queue)
        for target in (int(to_max[i - first]), int(to_min[i - first])):
            if target > last:
                return True
            if target > i and target not in reached:
                reached.add(target)
                heapq.heappush(queue, target)
    return False


def _groups(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, size: int):
    """``(recording, chunk, first, last, marks, to_max, to_min)`` of each chunk."""
    ids, chunks = rows["recording_id"].to_numpy(), rows["chunk"].to_numpy()
    idx, code = rows["idx"].to_numpy(), rows["code"].to_numpy()
    to_max, to_min = rows["max_idx"].to_numpy(), rows["min_idx"].to_numpy()
    for start, end in zip(starts.tolist(), ends.tolist()):
        marked = np.flatnonzero(code[start:end]) + start
        marks = dict(zip(idx[marked].tolist(), code[marked].tolist()))
        yield ids[start], chunks[start], int(idx[start]), (int(chunks[start]) + 1) * size, marks, to_max[start:end], to_min[start:end]


def _walk(size: int, d: int):
    """Walk chunks; one row of kind ``through`` tells that marks may pass a whole chunk."""
    def run(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out = []
        for name, chunk, first, last, marks, to_max, to_min in _groups(rows, starts, ends, size):
            walked = _walk_chunk(first, last, marks, to_max, to_min)
            out += [(name, chunk, i, c, kind) for kind, side in walked.items() for i, c in side.items()]
            if len(to_max) == size and _lets_through(first, last, d, to_max, to_min):
                out.append((name, chunk, 0, 0, "through"))
        return pd.DataFrame(out, columns=["recording_id", "chunk", "idx", "code", "kind"])

    return run


def _try_states(size: int, states: list[str]):
    """What chunks hand on when marks of some kinds stand on their first positions.

    A state says for each of these positions whether a mark is there: 0 for none, 1 for one that
    goes to maxima, 2 for one that goes to minima. ``out`` has the next chunk's first positions:
    0 for none, a code, or ``-p`` for the mark that stood on position ``p`` (from 1).
    """
    def run(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out = []
        for name, chunk, first, last, marks, to_max, to_min in _groups(rows, starts, ends, size):
            for state in states:
                handed = {first + k: 10 * (k + 1) + int(kind) for k, kind in enumerate(state) if kind != "0"}
                ahead = _walk_chunk(first, last, {**marks, **handed}, to_max, to_min)["ahead"]
                next_ = [0] * len(state)
                for i, code in ahead.items():
                    next_[i - last - 1] = code if code < 10 else -(code // 10)
                out.append((name, chunk, state, next_))
        return pd.DataFrame(out, columns=["recording_id", "chunk", "state", "out"])

    return run


def _state(codes: Column) -> Column:
    """The state of the codes on a chunk's first positions."""
    return F.array_join(F.transform(codes, lambda c: F.when(c == 0, "0").when(c % 2 == 1, "1").otherwise("2")), "")


def _applied(out: Column, codes: Column) -> Column:
    """The codes that a chunk hands on, given those handed to it."""
    return F.transform(out, lambda c: F.when(c < 0, F.element_at(codes, F.greatest(-c, F.lit(1)))).otherwise(c))


def _followed(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """What every chunk that ``moves`` lead to is handed: ``(recording_id, chunk, codes)``.

    ``moves`` (with ``out`` by chunk and state) are composed with themselves, so that after k
    rounds they lead 2^k chunks on, and what is known after 2^k chunks gives the next 2^k.
    """
    kinds = F.transform("out", lambda c: F.when(c < 0, F.substring("state", F.greatest(-c, F.lit(1)), F.lit(1))).otherwise(
        F.when(c == 0, "0").when(c % 2 == 1, "1").otherwise("2")))
    far = moves.select("recording_id", "chunk", "state", "out", (F.col("chunk") + 1).alias("to"), F.array_join(kinds, "").alias("then")).checkpoint()
    known = fresh = starts.select("recording_id", "chunk", "codes")
    while True:
        here = known.withColumn("state", _state(F.col("codes")))
        fresh = here.join(far, ["recording_id", "chunk", "state"]).select(
            "recording_id", F.col("to").alias("chunk"), _applied(F.col("out"), F.col("codes")).alias("codes")
        ).checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh).checkpoint()
        on = far.select(
            "recording_id", F.col("chunk").alias("to"), F.col("state").alias("then"), F.col("out").alias("_out"), F.col("to").alias("_to"), F.col("then").alias("_then")
        )
        far = far.join(on, ["recording_id", "to", "then"]).select(
            "recording_id", "chunk", "state", _applied(F.col("_out"), F.col("out")).alias("out"), F.col("_to").alias("to"), F.col("_then").alias("then")
        ).checkpoint()


def _handed_on(reach: DataFrame, walked: DataFrame, d: int, size: int) -> DataFrame:
    """The codes that each chunk is handed by the one before: ``(recording_id, chunk, codes)``, where there are any.

    Most chunks hand on the same whatever they are handed: any mark comes to rest inside. Only
    across those that marks may pass is the way of the marks followed, on tables of what the
    chunk makes of each state of its first ``d`` positions.
    """
    place = F.col("idx") - 1 - (F.col("chunk") + 1) * size
    codes = F.array(*[F.coalesce(F.max(F.when(place == k, F.col("code"))), F.lit(0)) for k in range(d)])
    handed = walked.where(F.col("kind") == "ahead").groupBy(*KEY).agg(codes.alias("codes")).withColumn("chunk", F.col("chunk") + 1).checkpoint()
    through = walked.where(F.col("kind") == "through").select(*KEY).checkpoint()
    if through.isEmpty():
        return handed
    none = F.array_repeat(F.lit(0), d)
    after = through.withColumn("chunk", F.col("chunk") + 1)
    # Chunks that follow a sure one know what they are handed.
    sure = handed.join(after, list(KEY), "left_anti")
    starts = sure.unionByName(
        through.join(after, list(KEY), "left_anti").join(sure, list(KEY), "left_anti").withColumn("codes", none)
    ).checkpoint()
    moves = through.join(handed.withColumn("chunk", F.col("chunk") - 1), list(KEY), "left").select(
        *KEY, F.lit("0" * d).alias("state"), F.coalesce("codes", none).alias("out")
    ).checkpoint()
    inside, tried = None, set()
    while True:
        found = _followed(moves, starts)
        unknown = found.withColumn("state", _state(F.col("codes"))).join(through, list(KEY), "left_semi").join(
            moves, [*KEY, "state"], "left_anti")
        missing = [r.state for r in unknown.groupBy("state").count().orderBy(F.desc("count"), "state").limit(STATES).collect()]
        if not missing:
            return found.where(F.exists("codes", lambda c: c != 0))
        if inside is None:
            inside = reach.join(through, list(KEY), "left_semi").checkpoint()
            near = moves.withColumn("state", _state(F.col("out"))).groupBy("state").count().orderBy(F.desc("count"), "state").limit(STATES)
            missing += [r.state for r in near.collect()] + ["0" * k + kind + "0" * (d - k - 1) for k in range(d) for kind in "12"]
        states = sorted(set(missing) - tried - {"0" * d})
        tried |= set(states)
        moves = moves.unionByName(map_groups(inside, list(KEY), "idx", _try_states(size, states), _MOVES)).checkpoint()


def snap_peaks_exact(signal: DataFrame, d: int, size: int = CHUNK) -> DataFrame:
    """``peak`` after visiting every mark in order and moving it to the first extreme in reach.

    A mark moved ahead is visited again and may move on; one moved back stays; the later
    write wins on a sample. Each chunk is walked on its own, as if it were handed nothing; then
    those that were handed marks are walked again with them. Over a slope that goes on for
    many chunks marks pass each of them: there a chunk is walked for the states that its first
    ``d`` samples may be in, and the chunks' tables are composed, two, four, eight at a time
    (:func:`_followed`), so a long slope costs a round of joins of small tables per doubling.
    Every state that occurs is tried, so the result is that of one walk over the recording.
    """
    if d <= 0:
        return signal
    if size < d:
        raise ValueError("a chunk must be at least as long as the snap half-width")
    scratch_root(signal.sparkSession)
    full = own_rows(extreme_columns(with_halo(signal, d, d, size), d), size)
    reach = full.select(*KEY, "idx", F.col("peak").alias("code"), "max_idx", "min_idx").checkpoint()
    walked = map_groups(reach, list(KEY), "idx", _walk(size, d), _OUT).checkpoint()
    handed = _handed_on(reach, walked, d, size).checkpoint()
    entering = handed.select(*KEY, F.posexplode("codes").alias("_place", "_new")).where(F.col("_new") != 0).select(
        *KEY, (F.col("chunk") * size + 1 + F.col("_place")).alias("idx"), "_new"
    )
    again = reach.join(handed, list(KEY), "left_semi").join(entering, [*KEY, "idx"], "left").withColumn("code", F.coalesce("_new", "code")).drop("_new")
    moved = walked.join(handed, list(KEY), "left_anti").unionByName(map_groups(again, list(KEY), "idx", _walk(size, d), _OUT))
    final = moved.where(F.col("kind").isin("here", "back")).groupBy("recording_id", "idx").agg(F.max_by("code", "chunk").alias("_code"))
    return unkeyed(
        keyed(signal).join(final, ["recording_id", "idx"], "left")
        .withColumn("peak", F.coalesce("_code", F.lit(0)))
        .select(*signal.columns)
    )
