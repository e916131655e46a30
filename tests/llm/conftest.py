"""Hostile rows for every corpus operator: nulls, empty and long texts, ties, copies, clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, kept boolean, shard int, id long, text_key string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def hostile_rows() -> list[tuple]:
    rng = random.Random(5)
    base, shared = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[40] = "changed"
    texts = [
        (0, base), (1, " ".join(near)), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (None, prose(rng, 50)),
        (None, None), (None, base), (7, "one two"), (8, "One  two"), (9, prose(rng, 80) + " " + shared), (10, shared + "\n" + prose(rng, 30)),
        (11, prose(rng, 6000)), (12, "ha " * 300), (13, "é ü ß 漢字 \u0001 </s> [INST] %3C \x0b end"), (14, prose(rng, 40)), (14, prose(rng, 40)),
        (100, shared), (200, base + " " + shared),
    ]
    return [
        (i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "r", k, True, k, k, "x")
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
