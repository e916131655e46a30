"""Removal of byte strings that repeat anywhere, by run-length indexes over the contexts of repeated anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import MIX, covered, mix, stored
from sigspark.llm.runindex import RunIndex
from sigspark.llm.substrings import let_through, sketch
from sigspark.operators.groups import map_groups

#: Bytes of contexts in one index, about.
INDEX_BYTES = 1 << 20
#: Contexts of one anchor in one index; those of a hotter anchor are indexed in pieces.
PIECE = 4096
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MIX)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` bytes, a power of two, by doubling."""
    out = _BYTE[data]
    step = 1
    while step < gram:
        out = out[: len(out) - step] * MIX + out[step:]
        out ^= out >> np.uint64(29)
        step *= 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every stretch of ``width``, by doubling."""
    place, value, step = np.arange(len(values), dtype=np.int32), values, 1
    while step < width:
        shift = min(step, width - step)
        right = value[shift:] < value[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
        value = np.minimum(value[shift:], value[:-shift])
        step += shift
    return place


def stretches(text: str | None, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, place, and the first and last of the windows they stand for.

    A window's anchor is the first run of ``gram`` bytes in it with the smallest hash; equal
    windows have equal anchors. Windows with one anchor follow each other.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    if len(data) < size:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    grams = _grams(data, gram)
    at = _least(grams, size - gram + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:] - 1, len(at) - 1)
    return grams[at[first]], at[first], first, last


def _context(data: bytes, place: int, first: int, last: int, size: int) -> bytes:
    """Digest of all bytes that an anchor's windows cover, and where in them it stands."""
    return xxhash.xxh3_128_digest(data[first : last + size], place - first)


def _emitter(bits, size: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text, ref in zip(batch.column("text").to_pylist(), batch.column("ref").to_pylist()):
                a, place, first, last = stretches(text, size, gram)
                if not len(a):
                    continue
                hit = np.flatnonzero(let_through(a, bits.value))
                data = text.encode()
                rows[0].extend(a[hit].view(np.int64).tolist())
                rows[2].extend([ref] * len(hit))
                rows[3].extend(first[hit].tolist())
                rows[4].extend(last[hit].tolist())
                rows[1].extend(_context(data, int(place[k]), int(first[k]), int(last[k]), size) for k in hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()))],
                ["a", "c", "ref", "first", "last"],
            )

    return emit


def _cutter(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for w in wanted:
                    rows[0].append(w["a"])
                    rows[1].append(w["c"])
                    rows[2].append(data[w["first"] : w["last"] + size])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.binary(), pa.binary()))], ["a", "c", "context"])

    return cut


def _searcher(size: int):
    """Windows of single contexts that occur elsewhere in their index; the open ones of hot anchors go on."""
    def search(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out: list[tuple] = []
        n, ref, first, pieces, spread = (rows[c].to_numpy() for c in ("n", "ref", "first", "pieces", "a"))
        context = rows["context"].to_numpy()
        for s, e in zip(starts.tolist(), ends.tolist()):
            parts = [np.append(np.frombuffer(context[k], np.uint8).astype(np.uint16) + 1, 0) for k in range(s, e)]
            # A match ends in the next context at the latest: no two of them are equal.
            length = RunIndex(np.concatenate(parts), 2 * max(map(len, parts))).matching_statistics()
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            for k in range(s, e):
                windows = len(context[k]) - size + 1
                hit = length[begin[k - s] : begin[k - s] + windows] >= size
                if n[k] > 1:
                    hit[:] = True
                found = np.flatnonzero(hit).astype(np.int32) if n[k] == 1 else np.empty(0, np.int32)
                if n[k] == 1:
                    out.append((ref[k], int(first[k]), found.tobytes(), None, None, None))
                if pieces[k] > 1:
                    # One row per context and shard of the hash: the rest is settled across pieces.
                    digests = np.array([xxhash.xxh3_64_intdigest(context[k][w : w + size]) for w in range(windows)], np.uint64)
                    shard = (digests >> np.uint64(32)) % np.uint64(pieces[k])
                    for q in np.unique(shard).tolist():
                        mine = np.flatnonzero(shard == q)
                        again = np.array([xxhash.xxh3_64_intdigest(context[k][w : w + size], 1) for w in mine.tolist()], np.uint64)
                        body = np.stack([digests[mine], again, (mine * 2 + hit[mine]).astype(np.uint64)])
                        out.append((ref[k], int(first[k]), None, int(spread[k]), int(q), body.tobytes()))
        return pd.DataFrame(out, columns=["ref", "first", "windows", "a", "shard", "body"], dtype=object)

    return search


def _settle(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """Open windows of a hot anchor whose digest occurs in another context too."""
    ref, first, body = (rows[c].to_numpy() for c in ("ref", "first", "body"))
    out: list[tuple] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        parts = [np.frombuffer(body[k], np.uint64).reshape(3, -1) for k in range(s, e)]
        table = np.concatenate(parts, axis=1)
        key = np.empty(table.shape[1], [("h", np.uint64), ("g", np.uint64)])
        key["h"], key["g"] = table[0], table[1]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        more = (count[back] > 1) & (table[2] % np.uint64(2) == 0)
        owner = np.repeat(np.arange(s, e), [p.shape[1] for p in parts])
        for k in np.unique(owner[more]).tolist():
            mine = table[2][more & (owner == k)] // np.uint64(2)
            out.append((ref[k], int(first[k]), mine.astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["ref", "first", "windows"], dtype=object)


def _remover(bits, size: int, gram: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list, ...] = ([], [], [])
            kept = []
            for text, single in zip(batch.column("text").to_pylist(), batch.column("single").to_pylist()):
                data = (text or "").encode()
                a, place, first, last = stretches(text, size, gram)
                hit = np.zeros(max(0, len(data) - size + 1), bool)
                if len(a):
                    through = let_through(a, bits.value)
                    hit = np.repeat(through, last - first + 1)
                    at = {int(f): k for k, f in enumerate(first)}
                    done = set()
                    for one in single or ():
                        k = at.get(one["first"])
                        if k is None or _context(data, int(place[k]), int(first[k]), int(last[k]), size) != one["c"]:
                            continue
                        if k not in done:
                            done.add(k)
                            hit[first[k] : last[k] + 1] = False
                        hit[first[k] + np.frombuffer(one["windows"], np.int32)] = True
                drop = covered(np.flatnonzero(hit), size, len(data)) if hit.any() else np.zeros(len(data), bool)
                counts[0].append(len(data))
                counts[1].append(int(drop.sum()))
                counts[2].append(int((drop[1:] & ~drop[:-1]).sum() + drop[:1].sum()))
                kept.append(np.frombuffer(data, np.uint8)[~drop].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(c, pa.int64()) for c in counts], pa.array(kept, pa.binary())],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return remove


def _anchor_hashes(size: int, gram: int):
    return lambda text: stretches(text, size, gram)[0]


def without_repeats(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), size: int = 200, gram: int = 64) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept)`` per row of ``docs``; ``row`` holds the ``carry`` columns.

    Texts are UTF-8 bytes. Every byte covered by a string of ``size`` bytes that also starts
    anywhere else, in the same or another row, is removed; ``kept`` is the rest. All strings
    are judged on the input. A null text is empty; repeated rows are copies of each other.

    Equal strings have equal anchors (``stretches``). What an anchor's strings cover is its
    context. Contexts are counted by digest, combined before the shuffle: one that occurs
    twice repeats as a whole, one whose anchor has no other context does not. Only single
    contexts that share an anchor with others are looked into: with these they make texts of
    about ``INDEX_BYTES``, each of which gets a run-length index (``RunIndex``); its matching
    statistics mark the strings that start elsewhere. Anchors with over ``PIECE`` different
    contexts are indexed in pieces, and strings still open are matched across pieces by 128
    bits of hash. A count-min sketch of anchors first passes over those that occur once.
    Runs jobs when called; intermediate tables lie in the shared scratch folder.
    """
    session = docs.sparkSession
    ref = F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    texts = docs.select(F.col(text_col).alias("text"), ref.alias("ref"))
    bits = session.sparkContext.broadcast(sketch(texts.select("text"), _anchor_hashes(size, gram)))
    contexts = stored(
        texts.mapInArrow(_emitter(bits, size, gram), "a long, c binary, ref long, first int, last int")
        .groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("ref", "first", "last")).alias("at"))
        .select("a", "c", "n", "at.*"),
        "contexts",
    )
    groups = contexts.groupBy("a").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1")
    open_ones = stored(contexts.join(groups.select("a", "k"), "a"), "open")
    total = open_ones.agg(F.sum(F.col("last") - F.col("first") + size)).first()[0] or 0
    indexes = max(1, math.ceil(total / INDEX_BYTES))

    wanted = open_ones.groupBy("ref").agg(F.collect_list(F.struct("a", "c", "first", "last")).alias("wanted"))
    one_each = texts.join(wanted.select("ref"), "ref", "left_semi").dropDuplicates(["ref"])
    cut = one_each.join(wanted, "ref").select("text", "wanted").mapInArrow(_cutter(size), "a long, c binary, context binary")
    pieces = F.ceil(F.col("k") / F.lit(PIECE)).cast("int")
    placed = open_ones.join(cut, ["a", "c"]).select(
        "a", "c", "n", "ref", "first", "context", pieces.alias("pieces"),
        F.when(pieces > 1, F.col("a")).otherwise(F.pmod(F.xxhash64("a"), F.lit(indexes))).alias("index"),
        F.pmod(F.xxhash64("c"), pieces).cast("int").alias("piece"),
    )
    searched = stored(
        map_groups(placed, ["index", "piece"], "a", _searcher(size), "ref long, first int, windows binary, a long, shard int, body binary"), "searched"
    )
    across = map_groups(searched.filter("body IS NOT NULL"), ["a", "shard"], "ref", _settle, "ref long, first int, windows binary")
    # What a text must know: its single contexts, with the strings in them that repeat after all.
    found = searched.filter("windows IS NOT NULL").select("ref", "first", "windows").union(across)
    lone = contexts.filter("n = 1").select("ref", "first", "c")
    exact = lone.join(found, ["ref", "first"], "left").select("ref", "first", "c", F.coalesce("windows", F.lit(b"")).alias("windows"))
    singles = exact.groupBy("ref").agg(F.collect_list(F.struct("first", "c", "windows")).alias("single"))
    whole = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"), ref.alias("ref"))
    fields = whole.schema["row"].dataType.simpleString()
    return whole.join(singles, "ref", "left").select("row", "text", "single").mapInArrow(
        _remover(bits, size, gram), f"row {fields}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
