"""Periodic runs against every lag of every text."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sigspark.llm.periods import periodic_runs, runs_of
from tests.llm import brute
from tests.llm.conftest import hostile_rows, prose


def found(texts):
    texts = sorted(texts, key=len, reverse=True)
    sizes = np.array([len(t) for t in texts], np.int64)
    got = list(map(tuple, runs_of(np.array([w for t in texts for w in t], np.int64), sizes).tolist()))
    want, first = [], 0
    for t in texts:
        want += [(s + first, e + first, q) for s, e, q in brute.runs(t)]
        first += len(t)
    return got, sorted(want, key=lambda r: (r[0], r[2]))


def nested(rng, depth):
    """Powers of powers with breaks between: runs in runs, of two words."""
    if depth == 0:
        return [rng.randint(0, 1) for _ in range(rng.randint(1, 6))]
    one = nested(rng, depth - 1)
    out = one * rng.randint(1, 10) + one[: rng.randint(0, len(one))] + [rng.randint(0, 2)] * rng.randint(0, 1)
    return (out + nested(rng, depth - 1) * rng.randint(0, 1))[:900]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_nested_powers(seed):
    rng = random.Random(seed)
    got, want = found([nested(rng, rng.randint(1, 4)) + nested(rng, rng.randint(1, 3)) for _ in range(3)])
    assert got == want


@pytest.mark.parametrize("seed", range(20))
def test_runs_whose_first_period_lies_in_a_smaller_run(seed):
    # v v of a short root, cut so that the copies do not line up: no hash of many words is left.
    rng = random.Random(seed)
    root = [rng.randint(0, 1) for _ in range(rng.randint(2, 15))]
    v = (root * rng.randint(5, 60))[: -rng.randint(1, len(root))]
    got, want = found([v + v + v[: rng.randint(0, len(v))], v + [2] + v + [2] + v])
    assert got == want


def test_runs_of_words_known_for_many_or_few():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = [bin(k).count("1") % 2 for k in range(900)]
    for texts in ([fibonacci[-1], thue], [[0] * 700, [0, 1] * 350, []], [list(range(500)), [7] * 11, [7] * 12]):
        got, want = found(texts)
        assert got == want


def test_equal_words_of_neighbouring_texts_are_no_run():
    got, want = found([[1, 2, 3, 4, 5, 6]] * 8)
    assert got == want == []


def test_work_does_not_grow_with_the_square_of_a_repetitive_text():
    text = [0, 1] * 100_000 + [0] + [0, 1] * 100_000
    runs = runs_of(np.array(text, np.int64), np.array([len(text)]))
    assert len(runs) == 99_999 and (runs[:, 1] - runs[:, 0] >= 2 * runs[:, 2]).all()


def plain(doc_id, text, tails):
    w = brute.words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute.runs(w)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    return doc_id, n, len(runs), *((top[0], top[1] - top[0], top[2]) if top else (None,) * 3), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.mark.parametrize("tails", [False, True])
def test_hostile_rows(spark, hostile, tails):
    rng = random.Random(3)
    more = [(k, prose(rng, rng.randint(1, 400))) for k in range(300, 360)]
    docs = hostile.select("doc_id", "text", "row", "size").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(
        (r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, tuple((x.start, x.start + x.length, x.period) for x in r.runs), r.collapsed)
        for r in periodic_runs(docs, tails=tails).collect() if r.doc_id is not None
    )
    rows = [(r[0], r[1]) for r in hostile_rows()] + more
    assert got == sorted(plain(i, t, tails) for i, t in rows if i is not None)
    assert periodic_runs(docs).filter("doc_id IS NULL").count() == sum(i is None for i, _ in rows)
    assert sum(r[2] > 0 for r in got) >= (5 if tails else 1)


def test_no_rows(nothing):
    assert periodic_runs(nothing).count() == 0
