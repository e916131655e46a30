"""A uniform shuffle into shards of exact sizes, in DataFrame operations only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import stored


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard in a uniform shuffle.

    Row by row: given what the shards still lack, a partition's rows fall into them as a
    multivariate hypergeometric draw. Rows sum to the counts, columns to sizes that differ by
    one at most.
    """
    total = sum(counts)
    lack = np.full(shards, total // shards, np.int64)
    lack[: total % shards] += 1
    draw = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for k, count in enumerate(counts):
        left = count
        rest = int(lack.sum())
        for s in range(shards):  # one hypergeometric draw per shard, as for a deck dealt out
            rest -= int(lack[s])
            out[k, s] = _draw(draw, int(lack[s]), rest, left)
            left -= out[k, s]
        lack -= out[k]
    return out


def _draw(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw; numpy's own ends at populations of 10^9."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return min(sample, good)
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, sample))
    return _inverted(draw.random(), good, bad, sample)


def _inverted(u: float, good: int, bad: int, sample: int) -> int:
    """The hypergeometric count at quantile ``u``, at any size.

    Chances go by their ratios from one count to the next, around the likeliest. Counts further
    off than 16 standard deviations, which have less than 1e-50 together, are not looked at.
    """
    n = good + bad
    likeliest = (sample + 1) * (good + 1) // (n + 2)
    spread = int(16 * math.sqrt(sample * (good / n) * (bad / n) * max(n - sample, 1) / n)) + 64
    first, last = max(0, sample - bad, likeliest - spread), min(good, sample, likeliest + spread)
    k = np.arange(first, last, dtype=np.float64)
    ratios = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    sums = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(sums, u * sums[-1], side="right").clip(0, len(sums) - 1))


def into_shards(docs: DataFrame, shards: int = 40, seed: int = 7, piece_rows: int = 1_000_000) -> DataFrame:
    """``(row, shard, slot)`` per row of ``docs``; ``row`` holds its columns.

    Every order of all rows is as likely as any other. Shard counts differ by one at most and
    ``slot`` runs from 0 without a gap in each. Rows get a partition by a digest of their
    columns (64 partitions, or as many as leave about ``piece_rows`` rows to each). How many go from each partition to each shard is
    drawn first; then each partition orders its rows at random and deals them out by those
    counts, and each shard orders what it got at random, in pieces of about a tenth of ``piece_rows``.

    The draws use the digests only, so a retried task or a rerun gives the same rows. Rows
    equal in all columns are alike and share a partition. Nulls are values like others; the
    columns must be of types that can be hashed and compared (no maps). Only the counts per
    partition, one number per ``piece_rows`` rows, reach the driver. Runs two jobs: the
    counts, and the dealt rows, which are written to the shared scratch folder.
    """
    names = docs.columns
    total = docs.count()
    parts = max(64, math.ceil(total / piece_rows))
    subs = max(1, math.ceil(total / shards / max(1, piece_rows // 10)))
    digest = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *[F.col(f"row.`{c}`") for c in names])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("part", F.pmod(digest(0), F.lit(parts)).cast("int"))
    counts = dict(rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = docs.sparkSession.createDataFrame(
        [(p, np.cumsum(line).tolist()) for p, line in enumerate(matrix)], "part int, ends array<long>"
    )
    local = Window.partitionBy("part").orderBy(digest(1), "row")
    dealt = stored(
        rows.withColumn("at", F.row_number().over(local)).join(ends, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("at"))))
        .withColumn("sub", F.pmod(digest(2), F.lit(subs)).cast("int"))
        .select("row", "shard", "sub"),
        "dealt",
    )
    earlier = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).select(
        "shard", "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = Window.partitionBy("shard", "sub").orderBy(digest(3), "row")
    return dealt.withColumn("at", F.row_number().over(place)).join(offsets, ["shard", "sub"]).select(
        "row", "shard", (F.col("before") + F.col("at") - 1).alias("slot")
    )
