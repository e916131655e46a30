"""Packing: the plan against plain best fit and the true optimum, pieces and sequences against the library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigspark.llm.packing import best_fit, packed, plan_of, reduced, sequences
from sigspark.llm.vocabulary import WordIds
from tests.llm import brute
from tests.llm.conftest import hostile_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def spelled(plan):
    return sorted(s for times, sizes in plan for _ in range(times) for s in sizes)


@pytest.mark.parametrize("seed", range(300))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 20, 30])
    low = rng.choice([1, 1, 3, capacity // 4 + 1])
    sizes = [rng.randint(min(low, capacity), capacity) for _ in range(rng.randint(0, 9))]
    counts = np.bincount(np.array(sizes, int), minlength=capacity + 1)
    assert sorted(capacity - sum(x) for n, x in best_fit(counts, capacity) for _ in range(n)) == brute.best_fit(sizes, capacity)
    fixed, left = reduced(counts, capacity)
    rest = [s for s in range(capacity + 1) for _ in range(left[s])]
    assert sorted(spelled(fixed) + rest) == sorted(sizes)
    # What is fixed is part of some best packing.
    assert sum(n for n, _ in fixed) + brute.fewest(rest, capacity) == brute.fewest(sizes, capacity)
    assert spelled(plan_of(counts, capacity)) == sorted(sizes)


def test_reduction_beats_best_fit_alone():
    # Best fit puts 6 with 4, and 5 with 3, 3 with 3 and so on; fixing whole sequences first does no harm.
    gained = 0
    for seed in range(400):
        rng = random.Random(seed)
        sizes = [rng.randint(20, 70) for _ in range(40)]
        counts = np.bincount(sizes, minlength=101)
        with_fixed, alone = sum(n for n, _ in plan_of(counts, 100)), sum(n for n, _ in best_fit(counts, 100))
        assert with_fixed <= alone + 1
        gained += alone - with_fixed
    assert gained >= 0


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    small, large = plan_of(counts, 2048), plan_of(counts * 1_000_000, 2048)
    assert len(large) < 3 * 2048 and sum(n for n, _ in large) <= sum(n for n, _ in small) * 1_000_000


def test_ids_of_words_are_those_of_whole_texts():
    texts = [r[1] or "" for r in hostile_rows()] + [
        "It's, they'LL. we've... 12,5. a.b,c.. <|endoftext|>. x<|startoftext|>y, T̈ ẗ İİ Ǻ é. ́a", "a b　c d\x1ce\x85f",
        "ΣΑΣ. ß ẞ ﬁ 각 \U0001f600, x.́ ..,., .a ,b c.\x00d", ". . .. ,", "A. B, C.,", "don't.", "9.,9",
    ]
    library = Tokenizer.from_file(PATH)
    import pyarrow as pa

    ids, counts = WordIds(PATH).encode(pa.array([*texts, None]))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pieces_and_sequences(spark, hostile):
    rng = random.Random(4)
    hot = [(7, "one two")] * 200  # one size and one row hold most rows
    docs = hostile.select("doc_id", "text").unionByName(spark.createDataFrame(hot + [(k, prose(rng, rng.randint(1, 90))) for k in range(500, 600)], "doc_id long, text string")).repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packed(docs, PATH, capacity=64, end=0, keep_ids=True).cache()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            raw = np.array(ids[k : k + 64], "<u4").tobytes()
            want[doc_id, k // 64, k, len(raw) // 4, zlib.crc32(raw), raw] += 1
    got = pieces.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in inside.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(inside) <= -(-sum(r.length for r in got) // 64) + 2
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in sequences(pieces).collect()}
    assert whole == {k: (sum(n for _, n, _ in v), b"".join(x for _, _, x in sorted(v))) for k, v in inside.items()}


def test_no_rows(nothing):
    assert packed(nothing, PATH).count() == 0
