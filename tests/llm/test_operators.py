"""Each corpus operator against a plain version, over hostile rows and over none."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import chat, decontaminate, minhash, mixing, quality, rangecoder, repeats, runindex, search, sharding, substrings, tokenids
from sigspark.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import hostile_rows, prose

ROWS = [(r[0], r[1]) for r in hostile_rows()]


def bag(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


# --- near duplicates ---------------------------------------------------------------

@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(hostile, words):
    got = bag(minhash.near_duplicates(hostile, words=words), "doc_id", "n_shingles", "component_id", "kept")
    want = Counter()
    for (i, n, c, kept), k in brute.near_duplicates(ROWS, words, 80).items():
        want[i, n, c, kept or (i is None and c is None)] += k
    assert got == want


def test_one_of_each_keeps_one_row_of_a_component(hostile, nothing):
    out = minhash.one_of_each(hostile)
    assert out.columns == hostile.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    by_component = Counter(c for (i, n, c, _) in brute.near_duplicates(kept, 5, 80) if n)
    assert max(by_component.values()) == 1
    assert {i for i, _ in kept} >= {0, 4, 5, 6, 9, 11, 12, 13} and Counter(i for i, _ in kept)[2] == 0
    assert minhash.one_of_each(nothing).count() == 0


def test_one_of_each_goes_by_component_not_by_id(spark):
    rng = random.Random(21)
    one, two, three, lone = (prose(rng, 80) for _ in range(4))
    rows = [
        (1, one), (1, two), (2, one + " more"), (3, two + " more"),  # unrelated texts of one id, each with a near copy
        (5, " \t"), (5, lone), (6, lone + " more"),  # a wordless text beside a worded one
        (None, three), (None, three + " more"), (None, "x " + three),  # near copies without ids
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in minhash.one_of_each(df).collect()]
    nameless = [x for x in got if x[0] is None]
    assert Counter(x for x in got if x[0] is not None) == Counter([(1, one), (1, two), (5, " \t"), (5, lone)])
    assert len(nameless) == 1 and nameless[0] in rows


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(3)
    base = prose(rng, 200).split()
    rows = []
    for k in range(400):
        copy = base[:]
        for place in rng.sample(range(200), 2):
            copy[place] = f"w{k}x{place}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows, 5, 80)


def test_blocks_of_a_bucket_find_what_the_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(8)
    chain = prose(rng, 100).split()
    rows = []
    for k in range(30):  # each is like its neighbours only
        chain = chain[4:] + prose(rng, 4).split()
        rows.append((k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag(minhash.near_duplicates(df, star_rounds=0), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows, 5, 80)


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = list(range(200))
    rng.shuffle(names)
    edges = [(max(a, b), min(a, b)) for a, b in zip(names, names[1:])]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges + edges[:5], "hi long, lo long")).collect()}
    assert set(got.values()) == {0} and len(got) == 199


# --- repeats -------------------------------------------------------------------------

def test_repeated_words(hostile, nothing):
    got = bag(substrings.without_repeats(hostile), "row.doc_id", "n_words", "n_removed", "kept")
    assert got == brute.without_word_repeats(ROWS, 35)
    assert substrings.without_repeats(nothing).count() == 0


def byte_digests(df):
    return bag(df, "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))


def test_repeated_bytes(hostile, nothing):
    assert byte_digests(repeats.without_repeats(hostile)) == brute.without_byte_repeats(ROWS, 200)
    assert repeats.without_repeats(nothing).count() == 0


def test_repeated_bytes_of_a_hot_anchor_in_pieces(spark, monkeypatch):
    """One passage in all documents, between texts that differ: its contexts are indexed in pieces."""
    monkeypatch.setattr(repeats, "PIECE", 5)
    rng = random.Random(2)
    passage, edge = prose(rng, 40), prose(rng, 30)
    rows = [(k, prose(rng, 40) + (edge if k % 9 == 0 else "") + passage + prose(rng, 40)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert byte_digests(repeats.without_repeats(df)) == brute.without_byte_repeats(rows, 200)


def test_run_index_measures_matches():
    rng = np.random.default_rng(0)
    for trial in range(20):
        parts = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(1, 40)).astype(np.uint8)) for _ in range(6)]
        parts += [parts[0][2:] + b"zz", b"q" + parts[1]]
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0) for p in parts])
        index = runindex.RunIndex(text)
        assert index.lengths.sum() == len(text) and (index.symbols[1:] != index.symbols[:-1]).all()
        found, at = index.matching_statistics(), 0
        for p in parts:
            for i in range(len(p)):
                want = max((n for n in range(1, len(p) - i + 1) if sum(q.startswith(p[i : i + n], x) for q in parts for x in range(len(q))) > 1), default=0)
                assert min(found[at + i], len(p) - i) == want
            at += len(p) + 1


# --- search ---------------------------------------------------------------------------

def bm25(rows, queries, k):
    docs = [brute.words((t or "").translate(brute.LOWER)) for _, t in rows]
    df = Counter(w for d in docs for w in set(d))
    n, mean = len(rows), max(1, sum(map(len, docs))) / max(1, len(rows))
    out = {}
    for q, text in queries:
        terms = set(brute.words((text or "").translate(brute.LOWER)))
        scores = []
        for (i, _), d in zip(rows, docs):
            tf = Counter(d)
            total = 0
            for t in terms & set(d):
                idf = np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                total += int(np.floor(1000 * (idf * (tf[t] * 2.2) / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))) + 0.5))
            if total >= 1:
                scores.append((-total, i if i is not None else 10**18))
        out[q] = [(-s, i) for s, i in sorted(scores)[:k]]
    return out


def test_search_is_exact_over_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("QUERY_ROWS", 3), ("BLOCK_ROWS", 4)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    vocabulary = prose(rng, 80).split()
    rows = [(k, " ".join(rng.choice(vocabulary[: 10 + k % 70]) for _ in range(rng.randint(1, 60)))) for k in range(150)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    queries = [r for r in rows if r[0] % 20 == 0]
    got = defaultdict(list)
    for r in search.top_k(df, df.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.doc_id))
    assert dict(got) == bm25(rows, queries, 7)


def test_a_query_goes_to_a_shard_with_four_bytes_a_term():
    """Hashes and weights go once a set; a query's terms are places among them."""
    terms = [np.array(x, np.uint64) for x in ([3, 2**63 + 1], [2**63 + 1], [1, 3, 7])]
    weight = {1: 0.5, 3: 1.5, 7: 2.5, 2**63 + 1: 3.5}
    rows = pd.DataFrame({
        "query": [{"id": k, "key": b"k"} for k in range(3)], "set": 0, "terms": [x.tobytes() for x in terms],
        "idf": [np.array([weight[int(v)] for v in x]).tobytes() for x in terms],
    })
    out = search._numbered(rows)
    assert [len(x) for x in out["terms"]] == [8, 4, 12] and out["vocabulary"].notna().tolist() == [True, False, False]
    vocabulary, idf = np.frombuffer(out["vocabulary"][0], np.uint64), np.frombuffer(out["idf"][0], float)
    assert dict(zip(vocabulary.tolist(), idf.tolist())) == weight and vocabulary.tolist() == sorted(weight)
    assert [vocabulary[np.frombuffer(x, np.uint32)].tolist() for x in out["terms"]] == [x.tolist() for x in terms]


def shard_rows(docs, sets, n):
    """What a shard's task reads: its documents, then its sets of queries as places among the set's terms; cut into batches anywhere."""
    df = Counter(h for _, t in docs for h in search.terms_of(t)[0].tolist())
    idf = lambda h: np.log(1 + (n - df[h] + 0.5) / (df[h] + 0.5))
    none = dict.fromkeys(("text", "terms", "vocabulary", "idf"))
    rows = [none | {"set": -1, "id": i, "key": brute_key(t), "text": t} for i, t in docs]
    for k, queries in enumerate(sets):
        lists = [search.terms_of(t)[0] for _, t in queries]
        numbered = search._numbered(pd.DataFrame({
            "query": [{"id": i, "key": brute_key(t)} for i, t in queries], "set": k, "terms": [x.tobytes() for x in lists],
            "idf": [np.array([idf(h) for h in x.tolist()]).tobytes() for x in lists],
        }))
        rows += [none | {"set": k, **r["query"], "terms": r["terms"], "vocabulary": r["vocabulary"], "idf": r["idf"]} for r in numbered.to_dict("records")]
    return rows


def brute_key(text):
    return hashlib.md5((text or "").encode()).digest()


def shard_batches(rows, size):
    schema = pa.schema([("shard", pa.int32()), ("set", pa.int32()), ("id", pa.int64()), ("key", pa.binary()), ("text", pa.string()), ("terms", pa.binary()), ("vocabulary", pa.binary()), ("idf", pa.binary())])
    return iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=size))


@pytest.mark.parametrize("common", [0, 5, 512])
def test_a_shard_reads_its_documents_once_and_then_its_sets_of_queries(monkeypatch, common):
    """Slabs, batches and gathered pieces of any size, cut anywhere, find what plain scoring finds; nothing passes from shard to shard."""
    for name, value in (("SLAB_ROWS", 18), ("BLOCK_ROWS", 4), ("BATCH_ROWS", 3), ("GATHERED", 8), ("COMMON", common)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(6)
    vocabulary = prose(rng, 60).split()
    docs = [(k // 2 if k % 9 else None, " ".join(rng.choice(vocabulary[: 5 + k % 50]) for _ in range(rng.randint(0, 40)))) for k in range(130)]
    sets = [[(1000 * j + i, t) for i, t in enumerate(x) if t] for j, x in enumerate(([t for _, t in docs[3::11]], [t for _, t in docs[5::17]], [" ".join(vocabulary)]))]
    rows = shard_rows(docs, sets, len(docs))
    other = shard_rows([(7, docs[7][1])], sets[:1], 1)  # a shard after it
    mean = sum(len(brute.words(t)) for _, t in docs) / len(docs)
    got = defaultdict(list)
    for out in search._searcher(7, mean)(shard_batches([{"shard": 0, **r} for r in rows] + [{"shard": 1, **r} for r in other if r["set"] < 0], 29)):
        for r in out.to_pylist():
            got[r["query"]["id"]].append((r["score"], r["doc_id"] if r["doc_id"] is not None else 10**18))
    assert {q: sorted(x, key=lambda y: (-y[0], y[1])) for q, x in got.items()} == bm25(docs, [q for x in sets for q in x], 7)


def test_a_shards_memory_is_that_of_a_slab_and_a_batch_of_queries():
    """A set eight times as large adds little besides its terms; nothing stays of a query but its best documents."""
    rng = np.random.default_rng(3)
    word = [f"w{k}" for k in range(20_000)]
    text = lambda: " ".join(word[int(x)] for x in 20_000 * rng.random(60) ** 3)
    docs, queries = [(k, text()) for k in range(3000)], [(k, text()) for k in range(4000)]
    peaks = []
    for n in (500, 4000):
        rows = [{"shard": 0, **r} for r in shard_rows(docs, [queries[:n]], len(docs))]
        given = [*shard_batches(rows, 1000)]
        tracemalloc.start()
        assert sum(x.num_rows for x in search._searcher(10, 60)(iter(given))) == 10 * n
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 10 and peaks[1] < 60, peaks


def test_a_document_goes_to_its_shard_once_however_many_sets_there_are(spark, monkeypatch):
    seen = lambda *_: lambda batches: (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column("id"), b.column("key")], ["id", "key"]), b.column("id"), b.column("key"), b.column("set").cast(pa.int64())], ["query", "doc_id", "doc_key", "score"]) for b in batches)
    for name, value in (("SHARD_ROWS", 10), ("MOST_SHARD_ROWS", 20), ("SHARDS", 2), ("QUERY_ROWS", 5), ("_searcher", seen)):
        monkeypatch.setattr(search, name, value)
    df = spark.createDataFrame([(k, f"word{k} both", "en") for k in range(60)], "doc_id long, text string, lang string")
    rows = search.top_k(df, df.withColumnRenamed("doc_id", "query_id"), 1000).groupBy("query_id", "score").count().collect()
    assert sorted(r.query_id for r in rows if r.score == -1) == [*range(60)] and all(r["count"] == 1 for r in rows if r.score == -1)
    assert len({r.score for r in rows}) > 10 and all(r["count"] == 3 for r in rows if r.score >= 0)  # every query goes to each of three shards


def test_search_over_hostile_rows(hostile, nothing):
    queries = hostile.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    got = Counter((r.query_id, r.score) for r in search.top_k(hostile, queries).collect())
    want = Counter((q, s) for q, found in bm25(ROWS, [r for r in ROWS if r[0] in (0, 100, 200)], 10).items() for s, _ in found)
    assert got == want
    assert search.top_k(nothing, nothing.withColumnRenamed("doc_id", "query_id")).count() == 0


# --- chat ------------------------------------------------------------------------------

def test_chat_comes_back_whole(spark, monkeypatch):
    rng = random.Random(6)
    nasty = ["</s>", "<s>[", "]\n", "%3C", "%", "[INST] ok [/INST]", "漢字 é", "", None, "plain", "\n", "a" * 50]
    turns = [(c, t % 7, rng.choice(["user", "assistant", None, "sys[tem]"]), rng.choice(nasty)) for c in (1, 2, None, 3) for t in range(20)]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (9, None, "assistant", "x")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, part string").repartition(4)
    none_first = lambda v: (v is not None, v if v is not None else 0)
    by_text = lambda v: (v is not None, v or "")
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (none_first(t[1]), by_text(t[2]), by_text(t[3])))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for part_bytes in (1 << 22, 40):
        monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
        shown = chat.formatted(df)
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(shown).collect()}
        assert got == want
        whole = shown.groupBy("conv_id").agg(F.sum(F.length("formatted"))).collect()
        assert {r[0]: r[1] for r in whole} == {r.conv_id: r.formatted_chars for r in chat.digests(shown).collect()}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# --- token ids ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("block_ids", [4096, tokenids.BLOCK_IDS])
def test_token_ids_come_back_from_the_files(spark, hostile, tokenizer, tmp_path, block_ids):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    path = str(tmp_path / "ids")
    rows = hostile.filter("doc_id IS NOT NULL AND doc_id NOT IN (2, 14)").unionByName(
        hostile.limit(1).withColumn("doc_id", F.lit(300).cast("long")).withColumn("text", F.lit("<|endoftext|> áb  x <|startoftext|>Σ's")))
    tokenids.write_ids(rows, tokenizer, path, block_ids=block_ids)
    got = sorted(map(tuple, tokenids.id_digests(spark, path).collect()))
    want, at = [], 0
    for i, text in sorted((r.doc_id, r.text) for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want and max(w[2] for w in want) > 2 * 4096


def test_token_ids_of_repeated_and_nameless_rows(hostile, nothing, tokenizer):
    found = tokenids.round_trip(hostile, tokenizer).orderBy("start").collect()
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ROWS)
    assert tokenids.round_trip(nothing, tokenizer).count() == 0


def test_range_coder_round_trip_and_gain():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, 300), np.array([65535]), np.zeros(1000, int), np.empty(0, int), np.tile([5, 9, 4000], 400)]
    coded = rangecoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded, [len(b) for b in blocks])))
    assert len(coded[2]) < 40 and len(coded[4]) < 300


@pytest.mark.parametrize("top", [3, 300, 65_536, 70_000, 1 << 31])
def test_range_coder_over_many_streams_and_large_ids(top):
    rng = np.random.default_rng(top)
    often = rng.integers(0, top, 500)
    for n in (1, rangecoder.STREAM, 3 * rangecoder.STREAM + 1, 40_000):
        block = np.where(rng.random(n) < 0.7, often[np.minimum(rng.geometric(0.02, n), 499)], rng.integers(0, top, n))
        block[n // 2 :] = block[: n - n // 2]
        assert (rangecoder.decode(rangecoder.encode([block]), [n])[0] == block).all()
    assert (rangecoder.decode(rangecoder.encode([np.array([top - 1])]), [1])[0] == top - 1).all()


def test_checksums_of_parts_join():
    rng = random.Random(8)
    for _ in range(20):
        parts = [rng.randbytes(rng.choice([0, 1, 7, 4096])) for _ in range(rng.randint(1, 6))]
        assert tokenids.joined_crc([zlib.crc32(x) for x in parts], [len(x) for x in parts]) == zlib.crc32(b"".join(parts))


def test_equal_rows_fill_several_files(spark, tokenizer, tmp_path):
    path, merging = str(tmp_path / "ids"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.createDataFrame([(3, "one two three")] * 4000, "doc_id long, text string").repartition(8)
    spark.conf.set(merging, "false")
    try:
        tokenids.write_ids(rows, tokenizer, path)
    finally:
        spark.conf.unset(merging)
    assert spark.read.parquet(path).select("file").distinct().count() > 3
    found = sorted(map(tuple, tokenids.id_digests(spark, path).collect()))
    assert [f[1] for f in found] == list(range(0, 16000, 4)) and len({(f[0], *f[2:]) for f in found}) == 1


def test_a_damaged_block_is_noticed(spark, tokenizer, hostile, tmp_path):
    tokenids.write_ids(hostile, tokenizer, str(tmp_path / "ids"))
    bad = spark.read.parquet(str(tmp_path / "ids")).withColumn("crc32", F.col("crc32") + 1)
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        tokenids.read_ids(spark, str(tmp_path / "bad")).collect()


# --- shards --------------------------------------------------------------------------------

def test_shards_are_even_gapless_and_repeatable(hostile, nothing):
    rows = hostile.unionAll(hostile)
    for subs in (1_000_000, 3):
        out = sharding.into_shards(rows, 5, piece_rows=subs)
        got = defaultdict(list)
        for r in out.select("shard", "slot").collect():
            got[r.shard].append(r.slot)
        sizes = [len(s) for s in got.values()]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in got.values())
        again = sharding.into_shards(rows.repartition(7), 5, piece_rows=subs)
        assert bag(out, "row.doc_id", "row.text", "shard", "slot") == bag(again, "row.doc_id", "row.text", "shard", "slot")
        assert bag(out.select("row.*"), *rows.columns) == bag(rows, *rows.columns)
    assert sharding.into_shards(nothing, 5).count() == 0


def test_communication_matrix_has_exact_sums_and_fair_cells():
    counts = [7, 0, 30, 13, 51]
    total = np.zeros((5, 4))
    for seed in range(400):
        matrix = sharding.communication_matrix(counts, 4, seed)
        assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == [26, 25, 25, 25]
        total += matrix
    assert np.abs(total / 400 - np.outer(counts, [26, 25, 25, 25]) / 101).max() < 0.5


def test_shuffle_is_uniform(spark):
    """Each of 60 rows falls into each of 3 shards about as often."""
    df, seen = spark.range(60), np.zeros((60, 3))
    for seed in range(30):
        for r in sharding.into_shards(df, 3, seed).select("row.id", "shard").collect():
            seen[r.id, r.shard] += 1
    assert abs(seen.sum(axis=1) - 30).max() == 0 and seen.max() <= 22 and (seen == 0).sum() <= 2


# --- mixing ----------------------------------------------------------------------------------

def fill(sizes: dict, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: float(cap * sizes[s]) if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]) if k % 3 else "a", int(rng.paretovariate(1.2) * 20)) for k in range(1500)]
    rows += [(k, "tiny", 2) for k in range(2000, 2010)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = fill(sizes)
    for piece in (1_000_000, 100):
        out = mixing.copies(df, F.col("words"), F.col("source"), [F.col("doc_id")], piece_rows=piece)
        got = out.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
        for r in got:
            mean = sizes[r.source] / sum(s == r.source for _, s, _ in rows)
            assert abs(r.target - want[r.source]) < 1e-6 and abs(r.taken - r.target) <= mean + 1 and r.most <= 3
        cells = bag(out, "row.doc_id", "copies")
        assert cells == bag(mixing.copies(df.repartition(5), F.col("words"), F.col("source"), [F.col("doc_id")]), "row.doc_id", "copies")


def test_mix_of_hostile_rows(hostile, nothing):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    keys = [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    out = mixing.copies(hostile, words, F.col("source"), keys)
    assert out.count() == len(ROWS) and out.filter("copies < 0 OR copies > 3").count() == 0
    mixed = mixing.mixed(hostile, words, F.col("source"), keys)
    assert mixed.columns == hostile.columns and mixed.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mixed(nothing, words, F.col("source"), keys).count() == 0
    assert mixing.copies(hostile.filter("text IS NULL"), words, F.col("source"), keys).filter("target <> 0").count() == 0


# --- decontamination --------------------------------------------------------------------------

def test_tiling_equals_the_plain_version():
    rng = random.Random(7)
    for trial in range(60):
        item = [rng.randrange(6 + trial) for _ in range(rng.randint(0, 30))]
        doc = item[15:] + [99] + item[:15] if trial % 2 else [rng.randrange(6 + trial) for _ in range(40)]
        found = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        covered = set()
        for j, i, n in found:
            assert doc[j : j + n] == item[i : i + n] and not covered & set(range(i, i + n))
            covered |= set(range(i, i + n))
        assert len(covered) == brute.tiles(doc, item, 3)


def test_leaks_whole_and_reordered_but_no_others(spark, hostile, nothing):
    rng = random.Random(11)
    items = [(0, prose(rng, 40)), (1, prose(rng, 40)), (2, None), (None, prose(rng, 30)), (3, "too short"), (4, ROWS[13][1])]
    a, b = items[0][1].split(), items[1][1].split()
    texts = [
        (500, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 50)), (501, " ".join(b[20:] + ["x"] + b[:20]).upper()),
        (502, " ".join(a[:12]) + " " + prose(rng, 60)), (503, items[3][1]), (503, items[3][1]), (504, items[0][1] + " " + items[1][1]),
    ]
    schema = hostile.schema
    docs = hostile.unionByName(spark.createDataFrame([(i, t, *[None] * 9) for i, t in texts], schema))
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = bag(decontaminate.leaking(docs, bench), "row.doc_id", "item_id")
    want = Counter({(500, 0): 1, (501, 1): 1, (503, None): 2, (504, 0): 1, (504, 1): 1, (9, 4): 1})
    assert got == want
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 6
    assert decontaminate.without_leaks(hostile, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.without_leaks(nothing, bench).count() == 0


# --- quality -----------------------------------------------------------------------------------

def test_quality_on_labels_it_has_not_seen(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(900):
        text, good, toxic = prose(rng, 60), 1, 0
        if k % 5 == 0:
            text, good = " ".join(w + rng.choice(["!!", "###", "$$$"]) for w in text.upper().split()), 0
        if k % 7 == 0:
            text, toxic = text + " zounds " + prose(rng, 5) + " gadzooks", 1
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, good, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r[0]: r[1] for r in quality.scored(docs, known).select("row.doc_id", "kept").collect()}
    fresh = [(got[i], bool(g and not t)) for i, g, t in labels if i % 2 == 0]
    assert sum(a == b for a, b in fresh) / len(fresh) > 0.97


def test_quality_of_hostile_rows(spark, hostile, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (12, 0, 0), (13, 0, 1), (14, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(hostile, labels, carry=tuple(hostile.columns))
    assert out.count() == len(ROWS) and out.filter("quality IS NULL OR toxic IS NULL OR isnan(quality)").count() == 0
    assert out.select("row.*").columns == hostile.columns
    assert quality.scored(nothing, labels).count() == 0
    assert quality.scored(hostile, labels.limit(0)).filter("kept").count() == 0


def test_every_unlabelled_row_may_teach_the_other_view(spark):
    """A source that lies behind the first 3,000 unlabelled rows of the order of ids, and in no label."""
    rng = random.Random(17)
    ids = [r[0] for r in spark.range(5000).orderBy(F.xxhash64(F.lit(3), "id")).collect()]
    last = set(ids[-60:])
    rows, labels = [], []
    for k in range(5400):
        text = prose(rng, 12)
        toxic = k in last or (k >= 5000 and k % 4 == 0)
        rows.append((k, text + " zounds gadzooks" if toxic else text, "en", "rare" if k in last else f"s{k % 3}"))
        if k >= 5000:
            labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    place = quality._bucket("source", "rare")
    assert place not in {quality._bucket("source", f"s{k}") for k in range(3)}
    trained = quality.train(docs, known)
    model = trained[0] if isinstance(trained, tuple) else trained
    assert model.views["toxic"][1][0].weights[-64 + place] > 0.05


def test_the_surest_rows_are_those_of_all_partitions(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(k, prose(rng, 5 + k % 40) + (" zounds" if k % 3 == 0 else ""), "en", "s") for k in range(300)] + [(None, "zounds zounds", None, None)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    scores = [bag(quality.scored(d, known), "row.doc_id", F.round("toxic", 9), "kept") for d in (docs.repartition(7), docs.coalesce(1))]
    assert scores[0] == scores[1] and sum(scores[0].values()) == 351
    whole = quality.scored(docs, known, carry=("doc_id", "text"))
    assert bag(whole, "row.doc_id", F.round("toxic", 9), "kept") == scores[0]


# --- nothing lost, nothing too often ---------------------------------------------------------

@pytest.mark.parametrize("size", [600, 900])
def test_repeats_longer_than_a_thousand_bytes(spark, size):
    """Shared passages of about a whole context, which is nearly twice the size."""
    rng = random.Random(size)
    shared = [prose(rng, 600)[: 2 * size - 120 + 40 * k] for k in range(4)]
    rows = [(k, prose(rng, 30) + shared[k % 4] + prose(rng, 30)) for k in range(24)] + [(90, shared[0][: size - 1]), (91, None), (92, shared[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.without_repeats(df, size=size).select("row.doc_id", "n_bytes", "n_removed", "kept").collect()}
    data = [list((t or "").encode()) for _, t in rows]
    drop = brute.repeated(data, size)
    assert got == {i: (len(u), sum(d), bytes(b for b, x in zip(u, d) if not x)) for (i, _), u, d in zip(rows, data, drop)}


def test_a_pair_is_met_in_the_first_band_whose_key_it_shares():
    rng = np.random.default_rng(2)
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)]
    for band in (0, 5, 31):
        keys = rng.integers(1, 2**62, (2, 32))
        keys[1, band:] = keys[0, band:]
        keys[1, :band] = keys[0, :band] + (1 << 16)  # equal in the low bits only
        rows = pd.DataFrame({
            "n": [100, 100], "block": [0, 0], "band": [band] * 2, "root": [b"a", b"b"], "i": [0, 0], "j": [0, 0],
            "bands": list(keys), "full": [x.tobytes() for x in sets],
        })
        found = minhash._linker(80)(rows, np.array([0]), np.array([2]))
        assert found.to_numpy().tolist() == [[b"b", b"a"]]
        other = minhash._linker(80)(rows.assign(band=(band + 1) % 32), np.array([0]), np.array([2]))
        assert len(other) == 0


def test_no_document_comes_more_than_three_times(spark):
    rows = [(k, "small", 0) for k in range(30)] + [(100 + k, "small", 7) for k in range(5)] + [(200 + k, "large", 400) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    out = mixing.copies(df, F.col("words"), F.col("source"), [F.col("doc_id")], weights=(50, 1)).persist()
    small = out.filter("row.source = 'small'")
    assert small.first().target == 3 * small.first().source_size == 105
    assert {r.copies for r in small.collect()} == {3} and out.agg(F.max("copies")).first()[0] <= 3


def test_a_heavy_tail_comes_near_its_target(spark):
    rows = [(k, "a", 1000) for k in range(3)] + [(10 + k, "a", 10) for k in range(20)] + [(100, "b", 4266)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    out = mixing.copies(df, F.col("words"), F.col("source"), [F.col("doc_id")], weights=(1, 1)).filter("row.source = 'a'").collect()
    taken = sum(r.size * r.copies for r in out)
    assert out[0].target == 3733 and abs(taken - 3733) < 0.04 * 3733 and max(r.copies for r in out) <= 3


def test_long_documents_are_drawn_by_their_words(spark):
    """Many sources of one make: how often each document is in, against the chance it should have."""
    sizes = [64, 80, 96, 112, 127, 128, 160, 200, 250, *[9] * 60]
    rows = [(1000 * s + k, f"s{s:04d}", n) for s in range(900) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    out = mixing.copies(df, F.col("words"), F.col("source"), [F.col("doc_id")], piece_rows=2)
    total, square = sum(sizes), sum(n * n for n in sizes)
    part = out.withColumn("whole", F.floor(F.col("target") / F.col("source_size"))).filter(F.abs(F.col("target") - (F.col("whole") + 0.5) * total) < 1e-6)
    share = dict(part.groupBy((F.col("row.doc_id") % 1000).alias("k")).agg(F.avg(F.col("copies") - F.col("whole"))).collect())
    rate = 0.5 * total / square
    for group in (range(5), range(5, 9)):
        words = sum(sizes[k] for k in group)
        drawn = int(rate * words)
        assert 0 < drawn < len(group) and sum(share[k] for k in group) == pytest.approx(drawn)
        for k in group:
            assert share[k] == pytest.approx(drawn * sizes[k] / words, abs=0.09)
        assert share[group[-1]] > share[group[0]] + 0.1
    taken = part.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target")).collect()
    assert max(abs(r.t - r.target) for r in taken) <= 5


@pytest.mark.parametrize("good, bad, sample", [(7, 30, 11), (400, 600, 250), (25_000, 975_000, 30_000)])
def test_large_draws_follow_the_hypergeometric_law(good, bad, sample):
    rng = np.random.default_rng(good)
    mine = np.array([sharding._inverted(u, good, bad, sample) for u in (np.arange(4000) + 0.5) / 4000])
    numpys = rng.hypergeometric(good, bad, sample, 200_000)
    assert mine.mean() == pytest.approx(numpys.mean(), rel=0.01) and mine.std() == pytest.approx(numpys.std(), rel=0.02)
    for q in (0.01, 0.1, 0.5, 0.9, 0.99):
        assert abs(np.quantile(mine, q) - np.quantile(numpys, q)) <= max(1, 0.05 * numpys.std())
    huge = sharding.communication_matrix([3 * 10**9, 0, 10**9, 5], 7, 1)
    assert huge.sum(axis=1).tolist() == [3 * 10**9, 0, 10**9, 5] and huge.sum(axis=0).max() - huge.sum(axis=0).min() <= 1
