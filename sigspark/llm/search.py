"""Exact top-k search by BM25: inverted indexes per shard, block maxima, global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import stored, text_key, word_hashes, words_of

K1, B = 1.2, 0.75
#: Scores are sums of whole numbers, a term's share in thousandths: sums are exact in any order.
SCALE = 1000
#: Documents of a shard, queries that visit it together, documents of a block of postings.
SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 8192, 8192, 64
#: Beyond so many shards they grow instead, to so many documents: each query is sent to every shard.
SHARDS, MOST_SHARD_ROWS = 32, 32768
#: Documents indexed at once, queries scored at once, postings gathered at once, terms whose lists are laid out in full.
SLAB_ROWS, BATCH_ROWS, GATHERED, COMMON = 2048, 256, 1 << 19, 512


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words (A-Z lower-cased), sorted, and how often each occurs."""
    words = words_of(text)
    words = b"\n".join(words).lower().split(b"\n") if words else []
    return np.unique(word_hashes(words), return_counts=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms_of(t)[0] for t in batch.column("text").to_pylist()]
        term, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column("query").to_pylist(), batch.column("text").to_pylist()
        found = [terms_of(t)[0] for t in texts]
        which = np.repeat(np.arange(len(keys)), [len(f) for f in found])
        term = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(which)), pa.array(term.view(np.int64))], ["query", "term"])


class Slab:
    """Postings of some documents by term, then document, before a query is known."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([n.sum() for _, n in found], float)
        term, tf = (np.concatenate(x) for x in zip(*found))
        doc = np.repeat(np.arange(len(found), dtype=np.min_scalar_type(len(found))), [len(t) for t, _ in found])
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term, self.doc, self.tf = term[order], doc[order], tf[order].astype(np.min_scalar_type(int(tf.max(initial=0))))
        new = np.append(True, term[1:] != term[:-1]) if len(term) else np.empty(0, bool)
        #: The lists' terms; ``begin`` bounds each list.
        self.terms, self.begin = term[new], np.append(np.flatnonzero(new), len(term))


class SlabIndex:
    """A slab's postings for the terms of a set of queries.

    The longest lists are laid out over all documents, with their largest impact in every block.
    """

    def __init__(self, slab: Slab, vocabulary: np.ndarray, idf: np.ndarray, mean_words: float):
        at = np.searchsorted(vocabulary, slab.terms)
        here = at < len(vocabulary)
        here[here] = vocabulary[at[here]] == slab.terms[here]
        n = np.diff(slab.begin)
        used = np.repeat(here, n)
        at, n, doc, tf = at[here], n[here], slab.doc[used], slab.tf[used].astype(float)
        norm = K1 * (1 - B + B * slab.size[doc] / mean_words)
        impact = np.floor(SCALE * (np.repeat(idf[at], n) * (tf * (K1 + 1)) / (tf + norm)) + 0.5)
        best = np.maximum.reduceat(impact, np.cumsum(n) - n) if len(n) else np.empty(0)
        long = np.argsort(-n, kind="stable")[:COMMON]
        long = long[(n[long] > 1) & (np.cumsum(best[long]) < 1 << 24)]  # whole numbers that 32-bit floats add without rounding
        self.blocks = -(-len(slab.size) // BLOCK_ROWS)
        self.width = self.blocks * BLOCK_ROWS
        #: The row of each term of the vocabulary among the common ones, or -1.
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[at[long]] = np.arange(len(long))
        row = np.repeat(self.row[at], n)
        self.common = np.zeros((len(long), self.width), np.float32)
        self.common[row[row >= 0], doc[row >= 0]] = impact[row >= 0]
        self.best = self.common.reshape(len(long), self.blocks, BLOCK_ROWS).max(2)
        #: The other lists, and by term of the vocabulary how long they are and where they begin.
        self.doc, self.impact = doc[row < 0].astype(np.int32), impact[row < 0]
        self.length = np.zeros(len(vocabulary), np.int32)
        rare = self.row[at] < 0
        self.length[at[rare]] = n[rare]
        self.begin = np.cumsum(self.length, dtype=np.int32) - self.length

    def rest(self, query: np.ndarray, terms: np.ndarray, n_queries: int) -> np.ndarray:
        """Scores by the lists that are not common, a row for each query; ``query`` ascends."""
        out = np.zeros((n_queries, self.width))
        n = self.length[terms]
        query, begin, n = query[n > 0], self.begin[terms[n > 0]], n[n > 0]
        end = np.cumsum(n)
        for cut in np.split(np.arange(len(n)), np.searchsorted(end, np.arange(GATHERED, end[-1] if len(n) else 0, GATHERED))):
            if len(cut):
                k, first, last = n[cut], query[cut[0]], query[cut[-1]]
                at = np.arange(k.sum(), dtype=np.int32) + np.repeat(begin[cut] - (np.cumsum(k, dtype=np.int32) - k), k)
                cell = np.repeat((query[cut] - first) * self.width, k) + self.doc[at]
                out[first : last + 1] += np.bincount(cell, self.impact[at], (last + 1 - first) * self.width).reshape(-1, self.width)
        return out


class Found:
    """The ``k`` best documents so far of every query of a set; a score of 0 is no hit."""

    def __init__(self, n_queries: int, k: int, ids: np.ndarray):
        self.score, self.place, self.ids = np.zeros((n_queries, k)), np.zeros((n_queries, k), np.int64), ids

    def least(self, queries: slice) -> np.ndarray:
        """What a score must reach, by query."""
        return np.maximum(1.0, self.score[queries, -1])

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Ties go to the smaller id."""
        old = np.unique(query)
        which, rank = np.nonzero(self.score[old])
        query, place, score = (np.append(x, y) for x, y in ((query, old[which]), (place, self.place[old[which], rank]), (score, self.score[old[which], rank])))
        order = np.lexsort((place, self.ids[place], -score, query))
        query, place, score = query[order], place[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.score.shape[1]
        self.score[query[kept], rank[kept]], self.place[query[kept], rank[kept]] = score[kept], place[kept]


def _search(index: SlabIndex, first_place: int, terms: np.ndarray, bounds: np.ndarray, found: Found) -> None:
    """Adds the slab's best documents for every query of a set, by block-max pruning.

    ``bounds`` has where the terms of each query begin. A block's scores are bounded by the common
    terms' largest impacts in it and its best score by all other terms. Blocks are scored from the
    highest bounds down, a few more each time, for the queries whose k-th score so far they may reach.
    """
    k = found.score.shape[1]
    for low in range(0, len(bounds) - 1, BATCH_ROWS):
        rows = slice(low, min(low + BATCH_ROWS, len(bounds) - 1))
        own, n = terms[bounds[rows.start] : bounds[rows.stop]], np.diff(bounds[rows.start : rows.stop + 1])
        query, row = np.repeat(np.arange(len(n)), n), index.row[own]
        asked = np.zeros((len(n), len(index.common)), np.float32)
        asked[query[row >= 0], row[row >= 0]] = 1
        rest = index.rest(query[row < 0], own[row < 0], len(n))
        peaks = rest.reshape(len(n), index.blocks, BLOCK_ROWS).max(2)
        bound = peaks + asked @ index.best
        # k blocks have a document each that reaches the k-th peak.
        known = np.partition(peaks, -k, axis=1)[:, -k] if index.blocks >= k else np.zeros(len(n))
        order, done, step = np.argsort(-bound.sum(0), kind="stable"), 0, 2
        while done < index.blocks:
            least, hits = np.maximum(found.least(rows), known), []
            for block in order[done : done + step].tolist():
                live = np.flatnonzero(bound[:, block] >= least)
                if len(live):
                    docs = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
                    score = asked[live] @ index.common[:, docs] + rest[live, docs]
                    which, doc = np.nonzero(score >= least[live, None])
                    hits.append((low + live[which], first_place + docs.start + doc, score[which, doc]))
            if hits:
                found.add(*(np.concatenate(x) for x in zip(*hits)))
            done, step = done + step, step * 4


class Shard:
    """A shard's documents as they come, and then its sets of queries."""

    def __init__(self, k: int, mean_words: float):
        self.k, self.mean_words = k, mean_words
        self.slabs: list[Slab] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[pa.Array] = []
        self.keys: list[pa.Array] = []

    def add(self, docs: pa.RecordBatch) -> None:
        for kept, name in ((self.ids, "id"), (self.keys, "key")):
            kept.append(docs.column(name).take(pa.array(np.arange(docs.num_rows))))  # a copy: a slice would hold the texts
        for text in docs.column("text"):
            self.waiting.append(terms_of(text.as_py()))
            if len(self.waiting) == SLAB_ROWS:
                self.close()

    def close(self) -> None:
        if self.waiting:
            self.slabs.append(Slab(self.waiting))
            self.waiting = []

    def top(self, queries: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best documents for a set of queries, whose vocabulary lies in the first row."""
        self.close()
        if not self.slabs:
            return
        column = lambda name: pa.concat_arrays([x.column(name) for x in queries])
        vocabulary, idf = (np.frombuffer(queries[0].column(c)[0].as_py(), kind) for c, kind in (("vocabulary", np.uint64), ("idf", float)))
        lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in column("terms")]
        terms, bounds = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        doc_id, doc_key = pa.concat_arrays(self.ids), pa.concat_arrays(self.keys)
        found = Found(len(lists), self.k, doc_id.fill_null(np.iinfo(np.int64).max).to_numpy())
        first = 0
        for slab in self.slabs:
            _search(SlabIndex(slab, vocabulary, idf, self.mean_words), first, terms, bounds, found)
            first += len(slab.size)
        which, rank = np.nonzero(found.score)
        place = pa.array(found.place[which, rank])
        query = pa.StructArray.from_arrays([column("id").take(pa.array(which)), column("key").take(pa.array(which))], ["id", "key"])
        yield pa.RecordBatch.from_arrays([query, doc_id.take(place), doc_key.take(place), pa.array(found.score[which, rank].astype(np.int64))], ["query", "doc_id", "doc_key", "score"])


def _searcher(k: int, mean_words: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of shard and set: a shard's documents come first, then one set of queries after another."""
        shard, queries, last = Shard(k, mean_words), [], (None, None)
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("shard", "set")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if (now := tuple(key[:, low].tolist())) != last:
                    if queries:
                        yield from shard.top(queries)
                        queries = []
                    if now[0] != last[0]:
                        shard = Shard(k, mean_words)
                    last = now
                rows = batch.slice(low, high - low)
                if now[1] < 0:
                    shard.add(rows)
                else:
                    queries.append(rows)
        if queries:
            yield from shard.top(queries)

    return search


def _numbered(queries: pd.DataFrame) -> pd.DataFrame:
    """A set's queries with their terms as places in the set's vocabulary, which lies, with its weights, in the first row."""
    lists = [np.frombuffer(t, np.uint64) for t in queries["terms"]]
    vocabulary, places = np.unique(np.concatenate(lists), return_inverse=True)
    idf = np.empty(len(vocabulary))
    idf[places] = np.concatenate([np.frombuffer(w, float) for w in queries["idf"]])
    terms = np.split(places.astype(np.uint32), np.cumsum([len(x) for x in lists])[:-1])
    once = lambda x: [x.tobytes(), *[None] * (len(lists) - 1)]
    return queries.assign(terms=[x.tobytes() for x in terms], vocabulary=once(vocabulary), idf=once(idf))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``k`` best rows of ``docs`` for every row of ``queries``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; ``queries`` has ``query_id`` and ``text``, whose
    distinct words are its terms. The score is BM25 over the words of whole texts with statistics
    of all documents, each term's share rounded to thousandths of whole points; ties go to the
    smaller id, then the smaller digest of the text. A document without a common word is no hit.

    Documents are dealt into shards of about ``SHARD_ROWS``, up to ``MOST_SHARD_ROWS`` once there
    are ``SHARDS``, and go to their shard once. Queries are dealt into sets of about ``QUERY_ROWS``;
    each set visits each shard after its documents, where an inverted index with block maxima, made
    for ``SLAB_ROWS`` documents at a time, finds the shard's best ``k``, and these merge exactly. A
    null id comes last among ties; null and
    empty texts are in no result and find nothing. Repeated queries (same id and text) count once,
    repeated documents are different rows. Runs jobs for the statistics.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).withColumn("doc_key", text_key(F.col("text")))
    queries = queries.select(F.struct(F.col("query_id").cast("long").alias("id"), text_key(F.col("text")).alias("key")).alias("query"), "text").dropDuplicates(["query"])
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    total = docs.agg(F.count("*").alias("n"), F.sum(n_words).alias("words")).first()
    n, mean_words = total["n"], max(1, total["words"] or 0) / max(1, total["n"])
    frequency = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    terms = queries.mapInArrow(_spread, "query struct<id:bigint,key:binary>, term long")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lists = stored(
        terms.join(frequency, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms"))
        .mapInArrow(_pack, "query struct<id:bigint,key:binary>, terms binary, idf binary"), "queries"
    )
    sets = max(1, math.ceil(lists.count() / QUERY_ROWS))
    shards = max(1, math.ceil(n / min(MOST_SHARD_ROWS, max(SHARD_ROWS, n / SHARDS))))
    left = docs.select(
        F.pmod(F.xxhash64("doc_id", "doc_key"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("set"), "lang", F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), "text"
    )
    # A set goes to every shard, so a term goes as a number of four bytes, and as a hash and a weight only once a set.
    right = lists.withColumn("set", F.pmod(F.xxhash64("query.id", "query.key"), F.lit(sets)).cast("int")).groupBy("set").applyInPandas(
        _numbered, "query struct<id:bigint,key:binary>, terms binary, idf binary, set int, vocabulary binary"
    ).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "set", "query.id", "query.key", "terms", "vocabulary", "idf")
    found = left.unionByName(right, allowMissingColumns=True).repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", "set", F.col("vocabulary").isNull(), F.col("lang").asc_nulls_last(), F.col("id").asc_nulls_last(), "key"
    ).drop("lang").mapInArrow(_searcher(k, mean_words), "query struct<id:bigint,key:binary>, doc_id long, doc_key binary, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc_key")
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query.id").alias("query_id"), "rank", "doc_id", "score")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("terms")
        bounds, rows = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        term, idf = rows.field("term").to_numpy(), rows.field("idf").to_numpy()
        pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("query"), pack(term), pack(idf)], ["query", "terms", "idf"])
