"""Maximal periodic runs of words, by lag scans for short periods and minimizers for long ones.

A run with period p repeats itself p words later, window minima included. So at each scale, for
periods from P up to 2P, equal minimizers that far apart seed an extension word by word; periods
too short for windows are found by comparing the text with itself at every lag. A window of
``P - k + 1`` hashes of ``k = P / 4`` words fits a period, so a run shows a pair of them.

Minimizers whose own words repeat every ``k / 3`` words or less would pair up without bound. They
are left out, which loses nothing: they lie in runs of a smaller scale, and a run all of whose
first period lies in such a run starts in that one and ends in the next of the same period.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import mix
from sigspark.llm.vocabulary import plain_text, portions, ragged, strings

#: Periods below this are found by lag scans; the scales begin here. At least 48: hashes of 12 words.
SHORT = 48
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row."""
    take, fill = (np.minimum, _NEVER) if least else (np.maximum, np.uint64(0))
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, fill, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = take.accumulate(blocks, axis=1).ravel()
    back = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(back[:n], ahead[width - 1 : width - 1 + n])


def _stretch(words: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places around ``at`` whose words all equal the words ``lag`` later."""
    ends = []
    for ahead in (True, False):
        place, size, limit = at, 64, len(words) - lag if ahead else 0
        while True:
            if ahead:
                to = min(place + size, limit)
                differ = words[place:to] != words[place + lag : to + lag]
            else:
                to = max(place - size, limit)
                differ = (words[to:place] != words[to + lag : place + lag])[::-1]
            if differ.any():
                ends.append(place + int(differ.argmax()) if ahead else place - int(differ.argmax()))
                break
            if to == limit:
                ends.append(limit)
                break
            place, size = to, min(size * 2, 1 << 16)
    return ends[1], ends[0]


def _adjacent(words: np.ndarray, runs: np.ndarray, low: int) -> tuple[list, list]:
    """Whole stretches, and seeds, of periods from ``low`` up to ``2 * low`` across touching runs of one period.

    Two touching runs of period r with one root agree at every lag of one residue modulo r. While
    both ends of such a stretch are those of the two runs, it needs no look at the words.
    """
    stretches, seeds = [], []
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    touching = (runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1])
    for k in np.flatnonzero(touching).tolist():
        (s, e, r), (t, f, _) = runs[k].tolist(), runs[k + 1].tolist()
        root, turned, shift = words[s : s + r], words[t : t + r], None
        for x in np.flatnonzero(root == turned[0]).tolist():
            if np.array_equal(np.roll(root, -x), turned):
                shift = x
                break
        if shift is None:
            continue
        lags = np.arange(low + (t - s - shift - low) % r, min(2 * low, e - s + 1, f - t + r + 1), r)
        inner = (t - lags > s) & (f - lags > e)
        stretches += [(t - lag, e, lag) for lag in lags[inner].tolist()]
        seeds += [(lag, max(s, t - lag)) for lag in lags[~inner].tolist()]
    return stretches, seeds


def runs_of(words: np.ndarray, sizes: np.ndarray, shortest: int = 12) -> np.ndarray:
    """``(start, end, period)`` of every run of texts that lie one after the other, longest text first.

    ``words`` are numbers below 2^32, ``sizes`` how many each text has. A run has at least
    ``max(shortest, 2 * period)`` words, the period is its smallest, and neither neighbour carries it
    on; ``shortest`` is at most 12 (runs that hold a short hash must have been found). Runs are
    sorted by start, then period.
    """
    if shortest > 12:
        raise ValueError("runs of 12 words must be found")
    ends = np.cumsum(sizes, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    # Equal numbers are equal words of one text.
    own = (owner << 32) | words.astype(np.int64)
    found = [np.empty((0, 3), np.int64)]

    def limit(period: int) -> int:
        """The end of the texts with room for two periods."""
        texts = int(np.searchsorted(-sizes, -2 * period, side="right"))
        return int(ends[texts - 1]) if texts else 0

    for lag in range(1, SHORT):
        n = limit(lag)
        if n <= lag:
            break
        hits = np.flatnonzero(own[: n - lag] == own[lag:n])
        if not len(hits):
            continue
        first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
        length = np.diff(first, append=len(hits))
        long = length >= max(shortest - lag, lag)
        start = hits[first[long]]
        found.append(np.stack([start, start + length[long] + lag, np.full(len(start), lag)], axis=1))

    low = SHORT
    if limit(low):
        n = limit(low)
        with np.errstate(over="ignore"):
            base = np.uint64(0x9E3779B97F4A7C15)
            power = np.cumprod(np.full(n + 1, base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))
            inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)) * base
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words[:n].astype(np.uint64) + base) * power[:n], dtype=np.uint64)])
    while n := limit(low):
        k = low // 4
        runs = np.concatenate(found)
        periodic = runs[(runs[:, 2] <= k // 3) & (runs[:, 1] - runs[:, 0] >= k) & (runs[:, 0] < n)]
        with np.errstate(over="ignore"):
            hashes = np.minimum(mix((sums[k : n + 1] - sums[: n - k + 1]) * inverse[: n - k + 1]), _NEVER - np.uint64(1))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, periodic[:, 0], 1)
        np.add.at(edge, periodic[:, 1] - k + 1, -1)
        hashes[(np.cumsum(edge[: len(hashes)]) > 0) | (owner[: len(hashes)] != owner[k - 1 : n])] = _NEVER
        width = low - k + 1
        least = _slide(hashes, width, least=True)
        best = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, least=False)
        places = np.flatnonzero((best == hashes) & (hashes != _NEVER))
        with np.errstate(over="ignore"):
            key = mix(hashes[places] + owner[places].astype(np.uint64) * base)
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        stretches, seeds = _adjacent(own, periodic, low)
        for step in itertools.count(1):
            apart = places[step:] - places[:-step]
            near = (key[step:] == key[:-step]) & (apart < 2 * low)
            fit = near & (apart >= low)
            seeds += zip(apart[fit].tolist(), places[:-step][fit].tolist())
            if not near.any():
                break
        lag, done = -1, 0
        for p, at in sorted(seeds):
            if p == lag and at < done:
                continue
            a, done = _stretch(own, p, at)
            lag = p
            stretches.append((a, done, p))
        new = np.array(stretches, np.int64).reshape(-1, 3)
        new = new[new[:, 1] - new[:, 0] >= np.maximum(new[:, 2], shortest - new[:, 2])]
        new[:, 1] += new[:, 2]
        found.append(new)
        low *= 2
    # What two periods of one run find is the same stretch; the smaller is its period.
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as numbers, how many each text has, and the words by number."""
    split = pa.compute.ascii_split_whitespace(plain_text(texts))
    counts = np.diff(split.offsets.to_numpy())
    words = split.flatten()
    real = pa.compute.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    return coded.indices.to_numpy()[real].astype(np.int64), np.bincount(owner, minlength=len(counts)), strings(coded.dictionary.cast(pa.large_binary()))


def _tail_period(doc_id: int | None, n: int) -> tuple[int, int]:
    """Where a repeating tail begins, and its period, for the rows that get one (period 0: none)."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return 0, 0
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()),
]


def _finder(tails: bool, shortest: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, 1 << 22):
                yield _found(some, tails, shortest)

    return find


def _found(some: pa.RecordBatch, tails: bool, shortest: int) -> pa.RecordBatch:
    """One row of results for every row."""
    ids = some.column("doc_id").to_pylist()
    numbers, sizes, vocabulary = _numbered(some.column("text"))
    starts = np.cumsum(sizes) - sizes
    if tails:
        for doc_id, first, n in zip(ids, starts.tolist(), sizes.tolist()):
            a, p = _tail_period(doc_id, n)
            if p:
                numbers[first + a : first + n] = np.resize(numbers[first + a : first + a + p], n - a)
    order = np.argsort(-sizes, kind="stable")
    runs = runs_of(numbers[ragged(starts[order], sizes[order])], sizes[order], shortest)
    ends = np.cumsum(sizes[order])
    places = np.searchsorted(ends, runs[:, 0], side="right")
    runs[:, :2] -= (ends - sizes[order])[places, None]
    rows = order[places]
    by_row = np.argsort(rows, kind="stable")
    runs, rows = runs[by_row], rows[by_row]
    bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
    columns: list[list] = [[] for _ in _FIELDS]
    for k, (doc_id, first, n) in enumerate(zip(ids, starts.tolist(), sizes.tolist())):
        own = runs[bounds[k] : bounds[k + 1]]
        words = [vocabulary[w] for w in numbers[first : first + n].tolist()]
        listed, top = [], (None, None, None)
        if len(own):
            length = own[:, 1] - own[:, 0]
            best = np.lexsort((own[:, 2], own[:, 0], -length))[0]
            s, e, p = own[best].tolist()
            top = (s, e - s, p)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.add.at(edge, own[:, 1], -1)
            words = list(itertools.compress(words, (np.cumsum(edge[:n]) == 0).tolist()))
            listed = [{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()]
        row = (doc_id, n, len(own), *top, listed, b" ".join(words).decode())
        for column, value in zip(columns, row):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], [name for name, _ in _FIELDS])


_SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
)


def periodic_runs(docs: DataFrame, shortest: int = 12, tails: bool = False) -> DataFrame:
    """The runs of every row's words, its longest, and ``collapsed``, the text with each run cut to one period.

    Words are runs of bytes other than space and 0x09-0x0D; a null or empty text has none, so no
    run, three nulls and an empty collapsed text. The longest run is the first by length, then
    start, then period. ``tails`` first gives a tenth of the rows (by a checksum of their id; none
    without an id) a repeating tail, for tests on prose. Every row gives one row, repeated rows
    theirs; only ``doc_id`` and ``text`` are read, whatever else the columns are called. A text
    stays in its task and is not moved.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_finder(tails, shortest), _SCHEMA)
