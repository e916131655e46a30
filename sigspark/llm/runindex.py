"""A run-length index of a bounded text: Burrows-Wheeler runs, values at run ends, matching statistics."""

from __future__ import annotations

import numpy as np

#: Matches are measured up to this length, if no other is asked for.
LONGEST = 1 << 10


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order; ``symbols`` are below 512.

    Ranks by the first seven symbols are refined by doubling, among undecided suffixes only.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key[: n - k] |= symbols[k:].astype(np.int64) << (9 * (6 - k))
    todo = np.argsort(key, kind="stable")
    key = key[todo]
    place = np.arange(n)
    head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
    rank = np.empty(n, np.int64)
    rank[todo] = head
    alone = np.append(head[1:] != head[:-1], True) & (head == place)
    todo, depth = todo[~alone], 7
    while len(todo):
        after = np.where(todo + depth < n, rank[np.minimum(todo + depth, n - 1)] + 1, 0)
        key = rank[todo] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        place = np.arange(len(todo))
        old = rank[todo]
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
        rank[todo] = old + head - group
        alone = np.append(head[1:] != head[:-1], True) & (head == place)
        todo, depth = todo[~alone], depth * 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Length of the common start of the suffixes at ``a`` and ``b``, eight bytes a step."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(0, longest, 8):
        differ = words[np.minimum(a[live] + step, n)] ^ words[np.minimum(b[live] + step, n)]
        same = differ == 0
        stop = live[~same]
        # Eight bytes lie in the word first byte lowest: count its equal low bytes.
        low = differ[~same]
        low = (low & (~low + np.uint64(1))).astype(np.float64)
        out[stop] = step + (np.log2(low).astype(np.int64) >> 3)
        live = live[same]
        if not len(live):
            break
    out[live] = longest
    return out


class RunIndex:
    """The Burrows-Wheeler transform in runs, with the text places at both ends of every run sampled.

    Separators are zero, bytes one higher than they are. Of the longest match of each place
    with its neighbour in suffix order only the values at run ends are kept: within a run, the
    match of a place is that of the place before less one, so they tell all others; ``longest``
    is the length up to which matches are measured: no match may be longer.
    """

    def __init__(self, symbols: np.ndarray, longest: int = LONGEST):
        longest = -(-longest // 8) * 8
        order = suffix_order(symbols)
        transform = np.where(order > 0, symbols[order - 1].astype(np.int64), -1)  # nothing stands before the text
        change = np.flatnonzero(transform[1:] != transform[:-1]) + 1
        first, last = np.append(0, change), np.append(change, len(order)) - 1
        self.symbols, self.size = transform[first], len(symbols)
        self.lengths = last - first + 1
        #: Sampled places: of every run's first row, with the row before; of its last, with the row after.
        self.heads, self.tails = order[first], order[last]
        data = np.zeros(len(symbols) + longest + 16, np.uint8)
        data[: len(symbols)] = (symbols - 1).astype(np.uint8)
        # Separators match nothing: a place in one ends every match, checked by the caller's bounds.
        words = np.lib.stride_tricks.sliding_window_view(data, 8)[: len(symbols) + longest + 1].copy().view(np.uint64).ravel()
        top = len(words) - 1
        self.up, self.down = np.zeros(len(first), np.int64), np.zeros(len(last), np.int64)
        self.up[1:] = _common(words, order[first[1:]], order[first[1:] - 1], top, longest)
        self.down[:-1] = _common(words, order[last[:-1]], order[last[:-1] + 1], top, longest)

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest start of each suffix that also starts elsewhere, in the order of the text."""
        best = np.zeros(self.size, np.int64)
        for place, value in ((self.heads, self.up), (self.tails, self.down)):
            reach = np.zeros(self.size, np.int64)
            reach[place] = place + value
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.size))
        return best
