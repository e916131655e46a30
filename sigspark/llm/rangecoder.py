"""An adaptive context-mixing range coder for token ids.

The ids of a block are dealt to streams, each a run of it, that are coded side by side and share
what they learn. An id takes at most two steps: is it what followed the last two ids before
(order 2), or, if these are new, the last one (order 1)? Else it is coded by how often ids came so
far (order 0). The chance of a yes mixes the three orders: how well the guesses of either context
did, whether they agree, and how common the guess is, weighed in the logistic domain with weights
that learn. All arithmetic is in whole numbers, so every machine decodes alike. A
block starts from nothing, whatever came before it.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a stream at most.
STREAM = 512
#: Sizes of the tables of what followed one and two ids; ids up to this are their own number.
_ONES, _TWOS, _DIRECT = 1 << 18, 1 << 20, 1 << 17
_P = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.round(256 * np.log(_P / (1 - _P))).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int32)
# How sure a guess is: right ones count up, wrong ones halve; below two it gives way to what came.
_SURER = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int32)
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 47)
_WORD, _BITS = np.uint64(48), np.uint64(16)
_DECISION = np.uint64(12)


class _Chance:
    """The chance that a guess is right, mixed from several counted chances and learnt weights."""

    def __init__(self, states: tuple[int, ...], weights: list[int]):
        self.right = [np.ones(n) for n in states]
        self.seen = [np.full(n, 2.0) for n in states]
        self.weights = weights
        self.refresh()

    def refresh(self) -> None:
        self.tables = [_STRETCH[(right * 4095 // seen).astype(np.int64)] for right, seen in zip(self.right, self.seen)]

    def mixed(self, states: list[np.ndarray], common: np.ndarray) -> np.ndarray:
        """In 4096ths; ``common`` is the order-0 chance of the guess, stretched."""
        self.states = states
        self.inputs = [*(table.take(state) for table, state in zip(self.tables, states)), common]
        total = self.inputs[0] * np.int32(self.weights[0])
        for one, weight in zip(self.inputs[1:], self.weights[1:]):
            total += one * np.int32(weight)
        total >>= 16
        np.minimum(total, 2047, out=total)
        np.maximum(total, -2047, out=total)
        total += 2047
        self.chance = _SQUASH.take(total)
        return self.chance

    def learn(self, asked: np.ndarray, right: np.ndarray) -> None:
        """``asked`` tells where there was a guess."""
        n = int(np.count_nonzero(asked))
        if not n:
            return
        miss = (right.astype(np.int32) * 4096 - self.chance) * asked
        for k, one in enumerate(self.inputs):
            moved = self.weights[k] + int((miss * one).sum(dtype=np.int64)) * 24 // (n << 12)
            self.weights[k] = max(-(1 << 17), min(moved, 1 << 17))
        for k, state in enumerate(self.states):
            size = len(self.seen[k])
            self.seen[k] += np.bincount(state, asked, size)
            self.right[k] += np.bincount(state, asked & right, size)
            # Counts are halved now and then, so that later ids weigh more.
            large = self.seen[k] > 1 << 20
            self.seen[k][large] = np.ceil(self.seen[k][large] / 2)
            self.right[k][large] = np.floor(self.right[k][large] / 2)
        self.refresh()


class _Models:
    """All that is learnt from the ids of a block so far."""

    def __init__(self, n_ids: int, streams: int):
        self.counts, self.bits = np.zeros(n_ids, np.int64), max(18, int(n_ids).bit_length() + 1)
        self.ones, self.twos = np.zeros(_ONES, np.int32), np.zeros(_TWOS, np.int32)
        self.last, self.before = np.zeros(streams, np.uint32), np.zeros(streams, np.uint32)
        self.chance = _Chance((8, 16), [40000, 20000, 8000])
        self.step, self.pending = 0, []
        self.refresh()

    def refresh(self) -> None:
        """Order 0 from the counts; a share is kept for ids that did not come yet."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
        self.pending = []
        room, total = (1 << self.bits) - len(self.counts), int(self.counts.sum())
        self.share = 1 + (self.counts * room // total if total else np.full(len(self.counts), room // len(self.counts)))
        self.ends = np.cumsum(self.share)
        self.table = np.repeat(np.arange(len(self.counts)), self.share)
        # By number plus one: zero stands for no guess.
        self.common = np.concatenate([np.zeros(1, np.int32), _STRETCH[np.minimum(self.share * 4096 >> self.bits, 4095)]])

    def begin(self, n: int) -> None:
        """Look up what the first ``n`` streams' last ids were followed by."""
        last, before = self.last[:n], self.before[:n]
        self.at_one = (last * np.uint32(0x9E3779B1) >> np.uint32(14)).astype(np.int64)
        self.at_two = ((last * np.uint32(0x85EBCA6B) ^ before * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(12)).astype(np.int64)
        one, two = self.ones.take(self.at_one), self.twos.take(self.at_two)
        self.guess_one, self.sure_one = one >> 3, one & 7
        self.guess_two, self.sure_two = two >> 3, two & 7

    def guess(self) -> np.ndarray:
        """The chance that the guess is right, 0 where there is none."""
        new = self.guess_two == 0
        self.guessed = np.where(new, self.guess_one, self.guess_two)
        self.asked = self.guessed > 0
        agree = self.guess_one == self.guess_two
        return self.chance.mixed([self.sure_two, self.sure_one * 2 + agree], self.common.take(self.guessed)) * self.asked

    def end(self, n: int, ids: np.ndarray, right: np.ndarray) -> None:
        if self.step < 64 or self.step % 4 == 0:
            self.chance.learn(self.asked, right)
        came = ids.astype(np.int32) + 1
        for table, at, guess, sure in ((self.ones, self.at_one, self.guess_one, self.sure_one), (self.twos, self.at_two, self.guess_two, self.sure_two)):
            same = guess == came
            table[at] = np.where(same | (sure >= 2), guess, came) << 3 | _SURER.take(sure + (same.astype(np.int32) << 3))
        self.before[:n] = self.last[:n]
        self.last[:n] = came
        self.pending.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 256 == 0:
            self.refresh()


def _dealt(n: int) -> np.ndarray:
    """The sizes of the streams of a block, falling, at most one apart."""
    streams = max(1, -(-n // STREAM))
    return n // streams + (np.arange(streams) < n % streams)


def _narrow(low: np.ndarray, wide: np.ndarray, chance: np.ndarray, right: np.ndarray) -> None:
    """Take the part of a yes or a no."""
    part = wide >> _DECISION
    yes = chance.astype(np.uint64) * part
    low += np.where(right, np.uint64(0), yes)
    wide[:] = np.where(right, yes, (part << _DECISION) - yes)


def _ready(low: np.ndarray, wide: np.ndarray, streams: np.ndarray | None = None) -> np.ndarray:
    """Of ``streams`` (default: all) those whose top word is settled; a range that straddles it for too long is cut."""
    a, w = (low, wide) if streams is None else (low[streams], wide[streams])
    settled = (a ^ (a + w)) < _TOP
    short = w < _BOTTOM
    found = np.flatnonzero(settled | short)
    cut = found[~settled[found]]
    found, cut = (found, cut) if streams is None else (streams[found], streams[cut])
    wide[cut] = (~low[cut] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
    return found


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids below 2^31 as bytes."""
    return [_encode(np.asarray(block).astype(np.int64)) for block in blocks]


def _encode(ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    # Large ids go by their rank among those of the block.
    known = np.unique(ids) if ids.max() >= _DIRECT else None
    if known is not None:
        ids = np.searchsorted(known, ids)
    n_ids = int(ids.max()) + 1
    sizes = _dealt(len(ids))
    starts = np.cumsum(sizes) - sizes
    streams = len(sizes)
    models = _Models(n_ids, streams)
    low, wide = np.zeros(streams, np.uint64), np.full(streams, 0xFFFFFFFFFFFFFFFF, np.uint64)
    data, fill = np.zeros((streams, int(sizes[0]) * 3 + 8), np.uint16), np.zeros(streams, np.int64)
    with np.errstate(over="ignore"):
        for t in range(int(sizes[0])):
            n = streams if t < sizes[-1] else int(np.count_nonzero(sizes > t))
            now, a, w = ids[starts[:n] + t], low[:n], wide[:n]
            models.begin(n)
            chance = models.guess()
            right = models.guessed == now + 1
            _narrow(a, w, chance, right)
            rest = np.flatnonzero(~right)
            if len(rest):
                some = now[rest]
                part = w[rest] >> np.uint64(models.bits)
                a[rest] += (models.ends[some] - models.share[some]).astype(np.uint64) * part
                w[rest] = models.share[some].astype(np.uint64) * part
            ready = _ready(a, w)
            while len(ready):
                data[ready, fill[ready]] = a[ready] >> _WORD
                fill[ready] += 1
                a[ready] <<= _BITS
                w[ready] <<= _BITS
                ready = _ready(a, w, ready)
            models.end(n, now, right)
        # Two words of a number within the last range end a stream.
        number = (low + (_BOTTOM - np.uint64(1))) >> np.uint64(47) << np.uint64(47)
        for shift in (48, 32):
            data[np.arange(streams), fill] = (number >> np.uint64(shift)) & np.uint64(0xFFFF)
            fill += 1
    names = b"" if known is None else zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes())
    head = np.array([n_ids, len(names)], "<u4").tobytes() + names
    words = data[np.arange(data.shape[1]) < fill[:, None]]
    return head + fill.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decode(blocks: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block; ``sizes`` tells how many."""
    return [_decode(block, size) for block, size in zip(blocks, sizes)]


def _decode(block: bytes, size: int) -> np.ndarray:
    if not size:
        return np.empty(0, np.uint32)
    n_ids, named = np.frombuffer(block, "<u4", 2).tolist()
    known = np.cumsum(np.frombuffer(zlib.decompress(block[8 : 8 + named]), "<u4").astype(np.int64)) if named else None
    sizes = _dealt(size)
    starts, streams = np.cumsum(sizes) - sizes, len(sizes)
    fill = np.frombuffer(block, "<u2", streams, 8 + named).astype(np.int64)
    words = np.concatenate([np.frombuffer(block, "<u2", -1, 8 + named + 2 * streams), np.zeros(8, np.uint16)]).astype(np.uint64)
    at = np.cumsum(fill) - fill
    code = np.zeros(streams, np.uint64)
    for k in range(4):
        code = code << _BITS | np.where(k < fill, words[at + np.minimum(k, fill)], 0).astype(np.uint64)
    ends = at + fill
    at = at + 4
    models = _Models(n_ids, streams)
    low, wide = np.zeros(streams, np.uint64), np.full(streams, 0xFFFFFFFFFFFFFFFF, np.uint64)
    ids = np.empty(size, np.int64)
    with np.errstate(over="ignore"):
        for t in range(int(sizes[0])):
            n = streams if t < sizes[-1] else int(np.count_nonzero(sizes > t))
            a, w, c = low[:n], wide[:n], code[:n]
            models.begin(n)
            chance = models.guess()
            right = c - a < chance.astype(np.uint64) * (w >> _DECISION)
            _narrow(a, w, chance, right)
            now = models.guessed.astype(np.int64) - 1
            rest = np.flatnonzero(~right)
            if len(rest):
                part = w[rest] >> np.uint64(models.bits)
                place = np.minimum((c[rest] - a[rest]) // part, np.uint64(len(models.table) - 1)).astype(np.int64)
                some = models.table[place]
                now[rest] = some
                a[rest] += (models.ends[some] - models.share[some]).astype(np.uint64) * part
                w[rest] = models.share[some].astype(np.uint64) * part
            ready = _ready(a, w)
            while len(ready):
                place = at[ready]
                c[ready] = c[ready] << _BITS | words[np.where(place < ends[ready], place, len(words) - 1)]
                at[ready] += 1
                a[ready] <<= _BITS
                w[ready] <<= _BITS
                ready = _ready(a, w, ready)
            ids[starts[:n] + t] = now
            models.end(n, now, right)
    return (ids if known is None else known[ids]).astype(np.uint32)
