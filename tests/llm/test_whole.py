"""Whole operators against plain versions with the same draws, and the pipeline over hostile and empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm import quality, sharding
from tests.llm.conftest import hostile_rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("piece_rows", [1_000_000, 4])
def test_shards_against_a_plain_dealing(spark, hostile, piece_rows):
    """The rows' digests as draws: dealt out by the matrix in plain Python, slot by slot."""
    shards, seed = 5, 7
    docs = hostile.unionAll(hostile.limit(7)).select("doc_id", "text", "size")
    digests = [F.xxhash64(F.lit(seed), F.lit(k), "doc_id", "text", "size").alias(f"d{k}") for k in range(4)]
    key = lambda r: tuple((v is not None, v) for v in (r.doc_id, r.text, r.size))
    rows = docs.select("*", *digests).collect()
    parts = max(64, -(-len(rows) // piece_rows))
    subs = max(1, -(-len(rows) // shards // max(1, piece_rows // 10))) if piece_rows == 1_000_000 else None
    by_part = [sorted((r for r in rows if r.d0 % parts == p), key=lambda r: (r.d1, key(r))) for p in range(parts)]
    matrix = sharding.communication_matrix([len(p) for p in by_part], shards, seed)
    dealt = [[] for _ in range(shards)]
    for part, line in zip(by_part, matrix.tolist()):
        for shard, n in enumerate(line):
            dealt[shard] += part[:n]
            part = part[n:]
        assert not part
    out = sharding.into_shards(docs, shards, seed, piece_rows).select("row.*", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text, r.size, r.shard) for r in out) == Counter((r.doc_id, r.text, r.size, s) for s, d in enumerate(dealt) for r in d)
    if subs == 1:
        order = {(s, k): key(r) for s, d in enumerate(dealt) for k, r in enumerate(sorted(d, key=lambda r: (r.d3, key(r))))}
        assert {(r.shard, r.slot): key(r) for r in out} == order


def test_exchange_does_no_harm_on_labels_it_has_not_seen(spark):
    """Few labels: with pseudo-labels from the other view no worse than without, on the rest of the labels."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    known, unseen = (labels.where((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0) == side) for side in (True, False))
    want = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in unseen.collect()}
    right = {}
    for rounds in (0, 3):
        got = quality.scored(docs, known, rounds=rounds).select("row.doc_id", "kept").collect()
        right[rounds] = sum(r.kept == want[r.doc_id] for r in got if r.doc_id in want) / len(want)
    assert right[3] >= 0.85 and right[3] >= right[0] - 0.02, right


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Hostile documents, and none at all, with labels and benchmark items."""
    out = {}
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in hostile_rows()]
    for name, some in (("hostile", rows), ("empty", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        docs.select(*columns).repartition(2).write.parquet(f"{out[name]}/documents.parquet")
        labels = [(i, int(k % 3 > 0), int(k % 7 == 6)) for k, (i, *_) in enumerate(rows)] if some else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out[name]}/labels.parquet")
        items = [(1, rows[16][1]), (2, None), (3, "")] if some else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out[name]}/benchmark.parquet")
    return out


@pytest.mark.parametrize("name", ["hostile", "empty"])
def test_pipeline_over_hostile_and_empty_tables(spark, folders, name):
    docs = spark.read.parquet(f"{folders[name]}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        # Every stage on all rows, null ids and texts included, not only on what the one before keeps.
        out = stage(spark, docs, folders[name])
        assert out.columns[: len(docs.columns)] == docs.columns
        kept = Counter(map(tuple, out.select(*docs.columns).collect()))
        given = Counter(map(tuple, docs.collect()))
        assert set(kept) <= set(given) and (number == 3 or all(n <= given[r] for r, n in kept.items()))
        assert number != 4 or kept == given
    assert corpus_pipeline.run(spark, folders[name]).count() <= 3 * docs.count()
