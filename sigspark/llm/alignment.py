"""Token ids of two tokenizers aligned by the bytes that they cover, and how often ids meet.

A tokenizer's tokens by the bytes they cover are a sparse 0/1 matrix. The product of one with the
transpose of the other, row by row (Gustavson), has an entry wherever two tokens overlap, its
value the number of shared bytes. Where tokens of both end, a group ends; the product of the two
token-by-group matrices links all tokens of a group.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import stored
from sigspark.llm.vocabulary import Flat, plain_text, portions, ragged, strings

#: Pairs in so many documents or more that at most this many exist go to every task.
COMMON = 1 << 16
#: Pairs of ids that a task counts before it hands the counts on.
HELD = 1 << 21
#: Bytes of text aligned together.
PORTION = 1 << 21


#: Stretches handed to a library as one.
JOINED = 32
_BLANK = r"[\x09-\x0d\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space, of any script, before a space, and a space at an end: such texts are not cut.
_RUNS_ON = f"(?:^|{_BLANK}) | $"
#: Stretches whose white space would run into a neighbour's, or that hold nothing else.
_EDGES = f"^ (?:{_BLANK}|$)|{_BLANK}$"


class Sparse:
    """A matrix by rows: where each row begins, the columns of its entries, their values."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int, values: np.ndarray | None = None):
        self.starts, self.columns, self.width = starts.astype(np.int64), columns.astype(np.int64), width
        self.values = np.ones(len(columns), np.int64) if values is None else values

    @classmethod
    def of_spans(cls, ends: np.ndarray) -> Sparse:
        """Row ``i`` has the columns from the end of the row before up to ``ends[i]``."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]), np.arange(n), n)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Sparse:
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        return Sparse(np.concatenate([[0], np.cumsum(counts)]), self.rows[order], len(self.starts) - 1, self.values[order])

    def times(self, other: Sparse) -> Sparse:
        """Row ``i`` is the sum of the rows of ``other`` that the columns of row ``i`` name."""
        sizes = np.diff(other.starts)[self.columns]
        places = ragged(other.starts[self.columns], sizes)
        cells = np.repeat(self.rows, sizes) * other.width + other.columns[places]
        values = np.repeat(self.values, sizes) * other.values[places]
        if (cells[1:] < cells[:-1]).any():
            order = np.argsort(cells, kind="stable")
            cells, values = cells[order], values[order]
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        values = np.add.reduceat(values, first) if len(first) else values
        cells = cells[first]
        starts = np.searchsorted(cells, np.arange(len(self.starts)) * other.width)
        return Sparse(starts, cells % max(other.width, 1), other.width, values)


class Vocabulary:
    """Ids and the bytes of each id, by either library."""

    def __init__(self, path: str):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            # No piece goes on past a space, so texts may be cut before each.
            self.divides = not any("▁" in name.lstrip("▁") for name in names)
            tokens = [bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            # Special tokens' strings in a text are plain text.
            self.library.encode_special_tokens = True
            names = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
            self.divides = [part for part, _ in self.library.pre_tokenizer.pre_tokenize_str(" a b. c")] == ["Ġa", "Ġb", ".", "Ġc"]
            tokens = [bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode() for name in names]
        self.size = len(tokens)
        self.bytes = Flat(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens]))
        self.lengths = np.diff(self.bytes.ends)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        if self.pieces:
            # This library puts the space before a text itself.
            return self.library.encode([text[1:] for text in texts], num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], n_bytes: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that begin with a space, and how many each has.

        Texts that ``joins`` allows are handed over ``JOINED`` at a time, as one; the bytes of the
        ids tell whose they are. Where these do not end with each text, texts go one by one.
        """
        found, order = [], []
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins).tolist()
        for k in range(0, len(together), JOINED * 256):
            some = together[k : k + JOINED * 256]
            firsts = np.arange(0, len(some), JOINED)
            lists = self._lists(["".join([texts[i] for i in some[j : j + JOINED].tolist()]) for j in firsts.tolist()])
            ids = np.array(list(itertools.chain.from_iterable(lists)), np.int64)
            ends, due = np.cumsum(self.lengths[ids]), np.cumsum(n_bytes[some])
            last = np.searchsorted(ends, due)
            if len(ids) and last[-1] < len(ids) and (ends[last] == due).all():
                found.append((ids, np.diff(last, prepend=-1)))
                order += some.tolist()
            else:
                alone += some.tolist()
        for k in range(0, len(alone), 4096):
            lists = self._lists([texts[i] for i in alone[k : k + 4096]])
            found.append((np.array(list(itertools.chain.from_iterable(lists)), np.int64), np.array([len(ids) for ids in lists], np.int64)))
        rows = np.empty(len(texts), np.int64)
        rows[np.array(order + alone, np.int64)] = np.arange(len(texts))
        parts = [np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in range(2)]
        return Flat(*parts).take(rows)


class Aligned:
    """Groups and links of different stretches of text, by number."""

    def __init__(self, a: Vocabulary, b: Vocabulary, texts: pa.Array):
        said, joins = strings(texts), pc.invert(pc.match_substring_regex(texts, _EDGES)).to_numpy(zero_copy_only=False)
        raw = np.frombuffer("".join(said).encode(), np.uint8)
        n_bytes = pc.binary_length(texts).to_numpy().astype(np.int64)
        joins &= a.divides and b.divides
        ids_a, n_a = a.encode(said, n_bytes, joins)
        ids_b, n_b = b.encode(said, n_bytes, joins)
        #: Whether the tokens of both give the stretch back.
        self.whole = _gives_back(a, ids_a, n_a, raw, n_bytes) & _gives_back(b, ids_b, n_b, raw, n_bytes)
        ids_a, ids_b = ids_a[np.repeat(self.whole, n_a)], ids_b[np.repeat(self.whole, n_b)]
        self.n_a, self.n_b, n_bytes = (np.where(self.whole, n, 0) for n in (n_a, n_b, n_bytes))
        ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        overlaps = Sparse.of_spans(ends_a).times(Sparse.of_spans(ends_b).transposed())
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_groups = [Sparse(np.arange(len(g) + 1), g, len(cuts)) for g in (group_a, group_b)]
        links = in_groups[0].times(in_groups[1].transposed())
        last_a, last_b = np.concatenate([[0], np.cumsum(self.n_a)]), np.concatenate([[0], np.cumsum(self.n_b)])
        bounds = np.concatenate([[0], np.cumsum(n_bytes)])
        self.n_groups = np.diff(np.searchsorted(cuts, bounds, side="right"))
        self.n_overlaps = np.diff(overlaps.starts[last_a])
        #: ``id of a * size of b + id of b`` of every link.
        self.pairs = Flat(ids_a[links.rows] * b.size + ids_b[links.columns], np.diff(links.starts[last_a]))
        self.said = _said(ids_a, ids_b, group_a, group_b, self.n_a, self.n_b)


def _gives_back(v: Vocabulary, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Which stretches the bytes of their ids, joined, equal."""
    joined, sizes = v.bytes.gathered(ids, counts)
    ends = np.cumsum(n_bytes)
    if len(joined) == len(raw) and np.array_equal(sizes, n_bytes) and np.array_equal(joined, raw):
        return np.ones(len(counts), bool)
    at = np.cumsum(sizes)
    return np.array([
        m == n and np.array_equal(joined[p - m : p], raw[q - n : q]) for m, n, p, q in zip(sizes.tolist(), n_bytes.tolist(), at.tolist(), ends.tolist())
    ], bool)


#: Ids as digits, with each of the three signs after them; made once in a worker.
_SAID = [np.empty(0, object)]


def _said(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """``a,a|b;a|b,b`` of the groups of each stretch, with a ``;`` after it."""
    ids, group = np.concatenate([ids_a, ids_b]), np.concatenate([group_a, group_b])
    order = np.argsort(group, kind="stable")
    ids, group, of_b = ids[order], group[order], order >= len(ids_a)
    # What follows an id: another of its tokenizer, the other tokenizer's, the next group.
    follows = np.zeros(len(ids), np.int64)
    follows[:-1] = np.where(group[1:] != group[:-1], 2, of_b[1:] != of_b[:-1])
    follows[-1:] = 2
    most = int(ids.max()) + 1 if len(ids) else 0
    if len(_SAID[0]) < 3 * most:
        _SAID[0] = np.array([b"%d%s" % (i, sign) for i in range(most) for sign in (b",", b"|", b";")], object)
    parts = _SAID[0][ids * 3 + follows].tolist()
    ends = np.cumsum(n_a + n_b).tolist()
    return [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends)]


_WORKER: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _WORKER:
        _WORKER[path] = Vocabulary(path)
    return _WORKER[path]


_FIELDS = [
    ("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
]
_ROWS = (
    "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
)


def _stretches(texts: pa.Array, divides: bool) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at single spaces, and the number of stretches of each; a stretch stands for a space and what follows.

    Neither tokenizer joins what lies on both sides of such a space. An empty text has no stretch.
    """
    if not divides:
        runs_on = pa.array(np.ones(len(texts), bool))
    else:
        runs_on = pc.match_substring_regex(texts, _RUNS_ON)
    lists = pc.split_pattern(texts, " ")
    whole = pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1)), texts)
    lists = pc.if_else(runs_on, whole, lists.cast(whole.type))
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    some = pc.binary_length(texts).to_numpy() > 0
    flat = flat.filter(pa.array(np.repeat(some, counts)))
    return flat, np.where(some, counts, 0)


def _aligner(path_a: str, path_b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _vocabulary(path_a), _vocabulary(path_b)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in portions(batch, PORTION):
                found = _rows(a, b, some)
                keys = np.arange(number, number + some.num_rows)
                number += some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(keys), some.column("doc_id"), *found], [n for n, _ in _FIELDS])

    return align


def _rows(a: Vocabulary, b: Vocabulary, some: pa.RecordBatch) -> list[pa.Array]:
    """The columns of the result from ``n_a`` on."""
    stretches, counts = _stretches(plain_text(some.column("text")), a.divides and b.divides)
    coded = stretches.dictionary_encode()
    where = coded.indices.to_numpy()
    blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    known = Aligned(a, b, pc.binary_join_element_wise(blank[1], coded.dictionary, blank[0]))
    ends = np.concatenate([[0], np.cumsum(counts)])
    broken = np.concatenate([[0], np.cumsum(~known.whole[where])])[ends]
    good = (np.diff(broken) == 0) & (counts > 0)
    where, counts = where[np.repeat(good, counts)], np.where(good, counts, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = lambda n: pa.array(np.diff(np.concatenate([[0], np.cumsum(n[where])])[ends]))
    pairs, n_links = known.pairs.gathered(where, counts)
    owner = np.repeat(np.arange(len(counts)), n_links)
    cells = np.sort(owner * (a.size * b.size) + pairs)
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    times = np.diff(first, append=len(cells)).astype(np.int32)
    cells = cells[first]
    bounds = pa.array(np.searchsorted(cells, np.arange(len(counts) + 1) * (a.size * b.size)).astype(np.int32))
    said = known.said
    digests = [
        hashlib.sha256(b"".join([said[k] for k in where[i:j].tolist()])[:-1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]
    return [
        total(known.n_a), total(known.n_b), total(known.n_groups), total(known.n_overlaps), pa.array(n_links), pa.array(digests),
        pa.ListArray.from_arrays(bounds, pa.array(cells % (a.size * b.size))), pa.ListArray.from_arrays(bounds, pa.array(times)),
    ]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have each pair; counts are handed on whenever many pairs are held."""
    held, size = [], 0

    def merged() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    for batch in batches:
        held.append(batch.column("pairs").flatten().to_numpy())
        size += len(held[-1])
        if size >= HELD:
            yield merged()
            held, size = [], 0
    if size:
        yield merged()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``: ``(row_key, doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs, times)``.

    ``pairs`` are the different pairs of linked ids as ``id of a * size of b + id of b``, ``times``
    how many links each has; ``n_overlaps`` counts token pairs that share a byte. Texts that are
    null or empty, or that the tokens of either do not give back, have zeros, no pairs and an
    empty digest. Rows are told apart by ``row_key``, so repeated ids and rows are no matter; only
    ``doc_id`` and ``text`` are read, whatever else the columns are called. ``path_a`` is a file of
    the tokenizers library (byte-level), ``path_b`` one of sentencepiece; both may be on either side.

    The tokens of a text are those of its stretches between single spaces, and a stretch begins
    and ends a group, so each different stretch of a portion of texts is aligned once.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_aligner(path_a, path_b), _ROWS)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)``: how many rows have each pair linked, and whether no pair of its first id has more."""
    counts = rows.select("pairs").mapInArrow(_counter, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # An id has at most as many pairs as the other tokenizer has ids.
    best = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size_b)))
    return counts.withColumn("best", F.col("n") == best)


def counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(row_key, n_best, count_sum)`` over the links of each row of ``aligned``.

    Common pairs are in most texts: those in more than a ``COMMON``-th of all entries (so at most
    ``COMMON`` pairs) go to every task. Only the others are matched by a join, where the largest
    key has that share at most.
    """
    spark = rows.sparkSession
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    common = sorted((r.pair, r.n, r.best) for r in counts.filter(F.col("n") * COMMON > total).collect())
    shared = spark.sparkContext.broadcast((
        np.array([p for p, _, _ in common], np.int64), np.array([n for _, n, _ in common], np.int64), np.array([b for _, _, b in common], np.int64)
    ))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            keys = batch.column("row_key").to_numpy()
            owner = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy())
            place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
            for out, of in zip(sums, (best, n)):
                np.add.at(out, owner[hit], times[hit] * of[place[hit]])
            rest = ~hit
            nothing = np.zeros(int(rest.sum()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys, keys[owner[rest]]])), pa.array(np.concatenate([sums[0], nothing])), pa.array(np.concatenate([sums[1], nothing])),
                    pa.array(np.concatenate([np.zeros(len(keys), np.int64), pairs[rest]]), mask=np.arange(len(keys) + len(nothing)) < len(keys)),
                    pa.array(np.concatenate([np.zeros(len(keys), np.int64), times[rest]])),
                ],
                ["row_key", "n_best", "count_sum", "pair", "times"],
            )

    parts = stored(rows.select("row_key", "pairs", "times").mapInArrow(split, "row_key long, n_best long, count_sum long, pair long, times long"), "link-parts")
    rare = counts.filter(F.col("n") * COMMON <= total)
    joined = parts.filter("pair IS NOT NULL").join(rare, "pair").select(
        "row_key", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    known = parts.filter("pair IS NULL").select("row_key", "n_best", "count_sum")
    return known.unionByName(joined).groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The rows of ``aligned`` with ``n_best``, links no pair of whose first id is in more rows, and ``count_sum``, the rows of each link's pair added up."""
    rows = stored(aligned(docs, path_a, path_b), "aligned")
    counts = stored(pair_counts(rows, Vocabulary(path_b).size), "pair-counts")
    return rows.drop("pairs", "times").join(counted(rows, counts), "row_key")
