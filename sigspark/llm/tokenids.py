"""Token ids of documents as files of coded blocks, and the way back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sigspark.llm import rangecoder
from sigspark.llm.common import stored, text_key
from sigspark.llm.vocabulary import portions, word_ids
from sigspark.sources.scratch import scratch_path

#: Ids of a block at most.
BLOCK_IDS = 1 << 22
FILE = (
    "file int, block long, n_ids int, crc32 long, payload binary, "
    "docs array<struct<doc_id:bigint,text_key:binary,count:int,part:int,whole:boolean>>"
)
PIECES = "file int, block long, place int, doc_id long, text_key binary, part int, whole boolean, inner long, count long, crc32 long, ids binary"
_DOC = pa.struct([("doc_id", pa.int64()), ("text_key", pa.binary()), ("count", pa.int32()), ("part", pa.int32()), ("whole", pa.bool_())])
_FILE_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(_DOC)]
_PIECE_KINDS = [
    pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
]


_FILE_NAMES = ["file", "block", "n_ids", "crc32", "payload", "docs"]


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _writer(path: str, end: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, number = word_ids(path), TaskContext.get().partitionId(), 0
        ids, docs, held = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal ids, docs, held, number
            block = np.concatenate(ids)
            row = (file, number, len(block), zlib.crc32(block), rangecoder.encode([block])[0], docs)
            ids, docs, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _FILE_KINDS)], _FILE_NAMES)

        for batch in batches:
            for some in portions(batch):
                found, counts = encoder.encode(some.column("text"))
                starts = np.cumsum(counts) - counts
                for doc_id, key, first, n in zip(some.column("doc_id").to_pylist(), some.column("text_key").to_pylist(), starts.tolist(), counts.tolist()):
                    own = np.append(found[first : first + n], end).astype("<u4")
                    if held and held + len(own) > block_ids:
                        yield closed()
                    whole = len(own) <= block_ids
                    for part, k in enumerate(range(0, len(own), block_ids)):
                        ids.append(own[k : k + block_ids])
                        docs.append({"doc_id": doc_id, "text_key": key, "count": len(ids[-1]), "part": part, "whole": whole})
                        held += len(ids[-1])
                        if not whole:
                            yield closed()
        if docs:
            yield closed()

    return write


def _reader(keep_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, number, size, crc, payload, docs = (column[k].as_py() for column in batch.columns)
                raw = memoryview(rangecoder.decode([payload], [size])[0].astype("<u4")).cast("B")
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"block {number} of file {file} is damaged")
                rows, at = [], 0
                for place, doc in enumerate(docs):
                    some = raw[4 * at : 4 * (at + doc["count"])]
                    rows.append((
                        file, number, place, doc["doc_id"], doc["text_key"], doc["part"], doc["whole"], at, doc["count"], zlib.crc32(some),
                        bytes(some) if keep_ids else None,
                    ))
                    at += doc["count"]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), _PIECE_KINDS)], _names(PIECES))

    return read


def _shifted(crc: int, n: int) -> int:
    """The checksum after ``n`` more zero bytes: times x^(8 n), modulo the checksum's polynomial."""
    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, left = 1 << 31, 1 << 30, 8 * n
    while left:
        if left & 1:
            power = times(power, square)
        square, left = times(square, square), left >> 1
    return times(power, crc)


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """The checksum of parts that follow each other, from theirs and their sizes in bytes."""
    out = 0
    for crc, size in zip(crcs, sizes):
        out = _shifted(out, size) ^ crc
    return out


@F.pandas_udf(LongType())
def _joined(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([joined_crc(c.tolist(), s.tolist()) for c, s in zip(crcs, sizes)], dtype="int64")


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each followed by ``end``, to files in ascending ``doc_id`` order.

    Rows are dealt by ranges of ``(doc_id, text)`` and sorted, so file after file and block after
    block hold them in order (null ids first, a null text is empty; equal rows are dealt along
    their place in the input, so many of them fill several files). A block holds whole documents,
    or a part of one longer than ``block_ids``; it is coded (``rangecoder``) and checksummed on its
    own. ``tokenizer`` is the library's file, the same on every executor, of a vocabulary that
    drops white space; ids may have 31 bits. The container is Parquet, so a lost task is written
    again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key(F.col("text")))
    placed = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange("doc_id", "text_key", "nth").drop("nth")
    placed = placed.sortWithinPartitions("doc_id", "text_key")
    placed.mapInArrow(_writer(tokenizer, end, block_ids), FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Pieces of documents with their ids (little-endian, 32 bits; null if not kept), checked against the blocks' checksums."""
    return spark.read.schema(FILE).parquet(path).mapInArrow(_reader(keep_ids), PIECES)


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files alone.

    ``start`` adds up the ids of earlier files, of earlier blocks of the file and of earlier
    documents of the block; the first two come from the blocks' counts, without their ids.
    """
    counts = spark.read.schema(FILE).parquet(path).select("file", "block", "n_ids")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "file").select(
        "file", "block", (F.col("file_start") + F.col("before")).alias("block_start")
    )
    # Ids are decoded once.
    pieces = stored(read_ids(spark, path, keep_ids=False).drop("ids", "text_key"), "pieces")
    one = pieces.filter("whole").select("file", "block", "doc_id", "count", F.col("crc32").alias("ids_crc32"), "inner")
    # A document of several blocks fills each of them; blocks of a document follow each other.
    several = pieces.filter("NOT whole").withColumn("first", F.col("block") - F.col("part")).groupBy("file", "first", "doc_id").agg(
        F.sum("count").alias("count"), F.sort_array(F.collect_list(F.struct("part", "crc32", (4 * F.col("count")).alias("size")))).alias("parts")
    ).select("file", F.col("first").alias("block"), "doc_id", "count", _joined("parts.crc32", "parts.size").alias("ids_crc32"), F.lit(0).cast("long").alias("inner"))
    return one.unionByName(several).join(blocks, ["file", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inner")).alias("start"), F.col("count").alias("n_tokens"), "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the files under the shared scratch folder and read them back (``id_digests``)."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path, end)
    return id_digests(docs.sparkSession, path)
