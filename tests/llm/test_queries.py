"""The registered corpus queries against their SQL on the smallest tables, and the pipeline's stages."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problems, rows = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLES[name])
    assert not problems and rows > 0


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_leaks_of_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum() or not 33 <= ord(c) < 127).split()
    want = set()
    for i, text in docs:
        doc = plain(text)
        grams = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for item in items:
            w = plain(item.text)
            if any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)) and 2 * brute.tiles(doc, w, 5) >= len(w):
                want.add((i, item.item_id))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_greedy_tiling"](spark, SF_DIR).collect()}
    assert got == want and want


def test_quality_against_the_labels(spark):
    found = QUERIES["op3_co_training"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    both = Counter(map(tuple, found.join(labels, "doc_id").select("kept", "good").collect()))
    assert both[True, True] + both[False, False] > 0.95 * sum(both.values())


def test_pipeline_stages_keep_the_columns_and_what_is_clean(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, before, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns[: len(columns)] == columns and (number == 4) == (len(after.columns) > len(columns))
        if number < 3:
            assert after.exceptAll(before).count() == 0
        if number == 1:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = Counter(i for (i, n, c, kept) in brute.near_duplicates(rows, 5, 80) if kept)
            assert Counter(r.doc_id for r in after.collect()) == want
        if number == 4:
            assert after.select(*columns).exceptAll(before).count() == 0 and after.count() == before.count()
        before = after
    assert corpus_pipeline.run(spark, SF_DIR).count() == before.count()
