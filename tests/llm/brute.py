"""Plain versions of the corpus operators, on one machine and in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_duplicates(rows, n, share):
    """``(doc_id, n_shingles, component_id, kept)`` per row ``(doc_id, text)``; null ids are the largest."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= share * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def repeated(units, size):
    """Per sequence of units, which are covered by a stretch of ``size`` that also starts elsewhere."""
    count = Counter(tuple(u[k : k + size]) for u in units for k in range(len(u) - size + 1))
    out = []
    for u in units:
        drop = [False] * len(u)
        for k in range(len(u) - size + 1):
            if count[tuple(u[k : k + size])] > 1:
                drop[k : k + size] = [True] * size
        out.append(drop)
    return out


def without_word_repeats(rows, size):
    units = [words(t) for _, t in rows]
    out = Counter()
    for (i, _), u, drop in zip(rows, units, repeated(units, size)):
        out[i, len(u), sum(drop), " ".join(w for w, d in zip(u, drop) if not d)] += 1
    return out


def without_byte_repeats(rows, size):
    units = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (i, _), u, drop in zip(rows, units, repeated(units, size)):
        spans = sum(d and not (k and drop[k - 1]) for k, d in enumerate(drop))
        out[i, len(u), sum(drop), spans, hashlib.sha256(bytes(b for b, d in zip(u, drop) if not d)).hexdigest()] += 1
    return out


def tiles(doc, item, least):
    """Words of ``item`` that greedy string tiling covers: the longest match left is marked, until none is left."""
    in_doc, in_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        in_item[i : i + n] = in_doc[j : j + n] = [True] * n
        covered += n


def runs(w, shortest=12):
    """``(start, end, period)`` of the maximal runs of a sequence, by every lag."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def best_fit(sizes, capacity):
    """Rooms left by best fit, pieces falling by size, one by one."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        open_ = [k for k, room in enumerate(rooms) if room >= size]
        if open_:
            rooms[min(open_, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def fewest(sizes, capacity):
    """The fewest sequences that hold all pieces, by trying everything."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for at in {room: n for n, room in enumerate(rooms) if room >= sizes[k]}.values():
            go(k + 1, [*rooms[:at], rooms[at] - sizes[k], *rooms[at + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def groups(a, b):
    """Groups ``(ids of a, ids of b)`` of two token lists ``(id, bytes)``; None unless both spell the same."""
    if b"".join(t for _, t in a) != b"".join(t for _, t in b):
        return None
    out, left, right, x, y = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if x <= y and a:
            i, t = a.pop(0)
            left.append(i)
            x += len(t)
        else:
            i, t = b.pop(0)
            right.append(i)
            y += len(t)
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out
