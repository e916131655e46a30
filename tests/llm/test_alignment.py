"""Alignment of two tokenizers against the libraries' tokens, group by group."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sigspark.llm.alignment import Sparse, Vocabulary, aligned, link_counts
from tests.llm import brute
from tests.llm.conftest import hostile_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    "two  spaces", " first", "last ", "line \n end\n", "\n start", "a  b", "a 　 b", "tab\t x\ty", "▁ piece ▁x", "<s> </s> <|endoftext|> <unk> <0x41>",
    "\U0001f600 漢字かな กำ", "x\x00y", "   ", " ", "\n", "it's we'll  don't", "a\x1c b\x85 c", "ﬁ Å é ½",
]


def byte_signs():
    # The signs that stand for bytes in such vocabularies: printable ones for themselves, the rest from 256 on.
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte_signs()


def tokens(libraries, text):
    a, b, signs = libraries
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    return left, right


def plain(libraries, rows):
    """Per row the contract's figures and the number of token pairs that share a byte."""
    found, holders = [], Counter()
    for _, text in rows:
        left, right = tokens(libraries, text) if text else ([], [])
        spelled = b"".join(t for _, t in left)
        groups = brute.groups(left, right) if text and spelled == (" " + text).encode() else None
        links = Counter((x, y) for g in groups or [] for x in g[0] for y in g[1])
        holders.update(links.keys())
        found.append((groups, links, left, right))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    out = Counter()
    for (doc_id, _), (groups, links, left, right) in zip(rows, found):
        if not groups:
            out[doc_id, 0, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        ends = [np.cumsum([len(t) for _, t in side]) for side in (left, right)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        overlaps = sum(int(((starts[1] < e) & (ends[1] > s)).sum()) for s, e in zip(starts[0], ends[0]))
        out[
            doc_id, len(left), len(right), len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if holders[x, y] == most[x]),
            sum(n * holders[p] for p, n in links.items()), overlaps, hashlib.sha256(said.encode()).hexdigest(),
        ] += 1
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_overlaps", "groups_sha256")


@pytest.mark.parametrize("common", [1, 3, 1 << 16])
def test_hostile_rows(spark, hostile, libraries, common, monkeypatch):
    monkeypatch.setattr("sigspark.llm.alignment.COMMON", common)
    rows = [(r[0], r[1]) for r in hostile_rows()] + [(1000 + k, t) for k, t in enumerate(MORE)]
    docs = hostile.select("doc_id", "text", "row", "size").unionByName(spark.createDataFrame(rows[-len(MORE):], "doc_id long, text string"), allowMissingColumns=True)
    got = Counter(map(tuple, link_counts(docs, A, B).select(*COLUMNS).collect()))
    assert got == plain(libraries, rows)


def test_documents_of_the_tables(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(map(tuple, link_counts(docs, A, B).select(*COLUMNS).collect()))
    assert got == plain(libraries, rows) and sum(n > 0 for (_, n, *_) in got) > 150


def test_products():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (rng.integers(0, 3, (rng.integers(1, 8), 5)) for _ in range(2))
        made = [Sparse(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], 5, m[m > 0]) for m in (x, y)]
        product = made[0].times(made[1].transposed())
        dense = np.zeros((len(x), len(y)), int)
        dense[product.rows, product.columns] = product.values
        assert (dense == x @ y.T).all() and (product.values > 0).all()


def test_either_side_and_whole_texts(spark, libraries, monkeypatch):
    # Where a vocabulary may join across a space, texts are not cut; sides may change.
    rows = [(k, t) for k, t in enumerate(["one two three", *MORE])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id, r.n_groups, r.n_links, r.n_overlaps)
    there, back = (sorted(map(key, aligned(docs, *paths).collect())) for paths in ((A, B), (B, A)))
    assert there == back
    assert Vocabulary(A).divides and Vocabulary(B).divides


def test_no_rows(nothing):
    assert link_counts(nothing, A, B).count() == 0
