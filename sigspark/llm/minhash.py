"""Near-duplicate documents: MinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import run_hashes, stored, text_key, word_hashes, words_of
from sigspark.llm.components import connected_components
from sigspark.operators.groups import map_groups

SIGNED = "id long, text_key binary, n_shingles long, set_key binary, bands array<long>"
#: Members of a bucket that meet in one task at a time, of either side.
BLOCK = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a lower-cased (A-Z) text.

    A text with fewer words is one shingle; one without words has none.
    """
    parts = words_of(text)
    parts = b"\n".join(parts).lower().split(b"\n") if parts else []
    if 0 < len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), len(parts))], np.uint64)
    return np.unique(run_hashes(word_hashes(parts), words))


def _families(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of a universal family on 64-bit values."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under every function, in slices that stay in cache."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 256):
        np.minimum(out, (values[k : k + 256, None] * a + b).min(axis=0), out=out)
    return out


def _signer(words: int, bands: int, rows: int, seed: int):
    a, b = _families(bands * rows, seed)
    marks = np.arange(1, bands + 1, dtype=np.uint64)[:, None]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sets, keys = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, words)
                size.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if len(found):
                    # The upper halves of the sums are the hash; a band is a digest of its rows.
                    low = (minima(found, a, b) >> np.uint64(32)).reshape(bands, rows)
                    run = run_hashes(np.concatenate([marks, low], axis=1).ravel(), rows + 1)[:: rows + 1]
                    keys.append(run.view(np.int64).tolist())
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return sign


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """One row per document: text and set digests, set size and band keys."""
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    return rows_in.mapInArrow(_signer(words, bands, rows, seed), SIGNED)


def _checker(words: int, share: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            hi, lo = batch.column("hi"), batch.column("lo")
            good = []
            for key, one, two in zip(hi.to_pylist(), batch.column("hi_text").to_pylist(), batch.column("lo_text").to_pylist()):
                if key != last:  # rows come in the order of this side
                    last, kept = key, shingle_set(one, words)
                other = shingle_set(two, words)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * both >= share * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([hi, lo, pa.array(good, pa.bool_())], ["hi", "lo", "linked"])

    return check


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """``pairs`` of set digests with ``linked``: whether the full sets pass the threshold."""
    joined = (
        pairs.join(texts.select(F.col("set_key").alias("lo"), F.col("text").alias("lo_text")), "lo")
        .join(texts.select(F.col("set_key").alias("hi"), F.col("text").alias("hi_text")), "hi")
        .select("hi", "lo", "hi_text", "lo_text")
    )
    return joined.mapInArrow(_checker(words, share), "hi binary, lo binary, linked boolean")


def _full_sets(words: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(sets, pa.binary())], ["set_key", "full"])

    return fill


def _linker(share: int):
    """Which components the sets of a block of one bucket link, as a forest: ``(hi, lo)`` of their roots.

    A pair is looked at in the first band whose key it shares, unless the block has linked its
    components already. It must pass the exact size test and reach the threshold on the full sets,
    which are looked at only if the sets' counts per bucket of hashes leave that open: two sets
    have no more in common than the smaller counts of all buckets together.
    """
    def link(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        n, block, band = (rows[c].to_numpy() for c in ("n", "block", "band"))
        root, names = pd.factorize(rows["root"])
        whole = (rows["i"] == rows["j"]).to_numpy()
        keys = np.stack(rows["bands"].to_list())
        sets = rows["full"].to_numpy()
        out = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            now = root[s:e].copy()
            counts = np.stack([np.bincount((np.frombuffer(v, np.uint64) >> np.uint64(54)).astype(np.int64), minlength=1024) for v in sets[s:e]])
            counts = counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int64)
            for x in range(s, e - 1):
                y = np.arange(x + 1, e)
                fit = (now[y - s] != now[x - s]) & (100 * np.minimum(n[y], n[x]) >= share * np.maximum(n[y], n[x]))
                if not whole[s]:
                    fit &= block[y] != block[x]
                y = y[fit]
                if not len(y):
                    continue
                y = y[(keys[y] == keys[x]).argmax(axis=1) == band[x]]
                most = np.minimum(counts[y - s], counts[x - s]).sum(axis=1, dtype=np.int64)
                y = y[100 * most >= share * (n[x] + n[y] - most)]
                mine = np.frombuffer(sets[x], np.uint64)
                for k in y.tolist():
                    if now[k - s] == now[x - s]:
                        continue
                    common = len(np.intersect1d(mine, np.frombuffer(sets[k], np.uint64), assume_unique=True))
                    if 100 * common >= share * (n[x] + n[k] - common):
                        a, b = names[root[x]], names[root[k]]
                        out.append((max(a, b), min(a, b)))
                        now[now == now[k - s]] = now[x - s]
        return pd.DataFrame(out, columns=["hi", "lo"], dtype=object)

    return link


def _block_links(now: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, share: int) -> DataFrame:
    """Links between different components within a bucket, met block by block, on full sets."""
    here = texts.join(now.select("set_key").distinct(), "set_key", "left_semi")
    full = nodes.select("set_key", "bands").join(here.mapInArrow(_full_sets(words), "set_key binary, full binary"), "set_key")
    blocks = now.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block")
    met = now.join(blocks, "bucket").select("*", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "band", "set_key", "n", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    ).join(full, "set_key")
    return map_groups(met, ["bucket", "i", "j"], "set_key", _linker(share), "hi binary, lo binary").distinct()


def links(
    signatures: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, share: int, star_rounds: int,
) -> DataFrame:
    """``(node, root)`` of the components of the distinct sets, for nodes that are not roots.

    Candidates are met bucket by bucket. In each of ``star_rounds`` rounds every bucket that
    still holds more than one component tests its members against one pivot, a different one
    per round; confirmed pairs join components, so a large group of near copies costs a few
    rows per member, not its pairs. The members of buckets that are still mixed then meet in
    blocks of bounded size, which hand on a forest of links between components each.
    """
    nodes = stored(
        signatures.filter("set_key IS NOT NULL").groupBy("set_key").agg(
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.min(F.struct("text_key", "id")).alias("at"),
        ), "nodes",
    )
    buckets = nodes.select(F.posexplode("bands").alias("band", "bucket"), "set_key", "n")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = stored(buckets.join(shared.select("bucket"), "bucket"), "buckets")

    # One text per set that has company: by the digest of a text, then one row of it.
    wanted = nodes.join(members.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "at.text_key", F.col("at.id").alias("id"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_key", text_key(F.col("text")))
    same = (wanted["text_key"] == source["text_key"]) & wanted["id"].eqNullSafe(source["id"])
    texts = stored(source.join(wanted, same).select(wanted["set_key"], "text").dropDuplicates(["set_key"]), "texts")

    near = F.expr(f"100 * least(n, other_n) >= {share} * greatest(n, other_n)")
    now, tested, labels = members.withColumn("root", F.col("set_key")), None, None
    for turn in range(star_rounds):
        order = F.xxhash64(F.lit(turn), "set_key")
        pivot = now.groupBy("bucket").agg(F.min(F.struct(order, "set_key", "n", "root")).alias("p")).select(
            "bucket", F.col("p.set_key").alias("other"), F.col("p.n").alias("other_n"), F.col("p.root").alias("other_root")
        )
        pairs = now.join(pivot, "bucket").filter(F.col("root") != F.col("other_root")).filter(near).select(
            F.greatest("set_key", "other").alias("hi"), F.least("set_key", "other").alias("lo")
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["hi", "lo"], "left_anti")
        result = stored(confirmed(pairs, texts, words, share), "pairs")
        tested = result if tested is None else tested.union(result)
        labels = stored(connected_components(tested.filter("linked").select("hi", "lo")), "labels")
        now = members.join(labels, members["set_key"] == labels["node"], "left").select(
            "bucket", "band", "set_key", "n", F.coalesce("root", "set_key").alias("root")
        )
        mixed = now.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
        now = stored(now.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")
    # What is left links roots; their own roots then stand for all they stood for.
    last = stored(connected_components(_block_links(now, nodes, texts, words, share)), "labels")
    if labels is None:
        return last
    over = last.select(F.col("node").alias("over"), F.col("root").alias("top"))
    return labels.join(over, labels["root"] == over["over"], "left").select("node", F.coalesce("top", "root").alias("root")).union(last)


def rooted(
    docs: DataFrame, id_col: str, text_col: str, words: int, share: int, bands: int, rows: int, seed: int, star_rounds: int,
) -> tuple[DataFrame, DataFrame]:
    """``(id, text_key, n_shingles, root)`` of the rows with words, and those without, which have no root."""
    signatures = stored(signed(docs, id_col, text_col, words, bands, rows, seed), "signatures")
    labels = links(signatures, docs, id_col, text_col, words, share, star_rounds)
    rows_out = signatures.select("id", "text_key", "n_shingles", "set_key")
    found = rows_out.filter("set_key IS NOT NULL").join(labels, rows_out["set_key"] == labels["node"], "left").select(
        "id", "text_key", "n_shingles", F.coalesce("root", "set_key").alias("root")
    )
    return found, rows_out.filter("set_key IS NULL").select("id", "text_key", "n_shingles")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80,
    bands: int = 32, rows: int = 4, seed: int = 1, star_rounds: int = 1,
) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``share`` per
    cent or more are linked; ``component_id`` is the smallest id reachable and ``kept`` marks
    it. Two sets at the threshold share none of the bands with a probability of
    ``(1 - (share/100)^rows)^bands``, 5e-8 with the defaults; candidates are confirmed on the
    full sets. Equal sets are one node, so copies cost one row each.

    Null or wordless texts have no shingles and stand alone. A null id is larger than any
    other: a component without ids has a null ``component_id`` and keeps its rows. Repeated
    rows each give a row. Only the two named columns are read. Runs jobs when called.
    """
    with_words, without = rooted(docs, id_col, text_col, words, share, bands, rows, seed, star_rounds)
    least = with_words.groupBy("root").agg(F.min("id").alias("component_id"))
    found = with_words.join(least, "root").select("id", "text_key", "n_shingles", "component_id")
    alone = without.select("id", "text_key", "n_shingles", F.col("id").alias("component_id"))
    return found.union(alone).select(
        F.col("id").alias("doc_id"), "text_key", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 80,
    bands: int = 32, rows: int = 4, seed: int = 1, star_rounds: int = 1,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one document of each component stays.

    Columns and values are those of ``docs``. A component is the texts linked as in
    ``near_duplicates``, whatever their ids: of each the row with the smallest id stays, null
    last, and of several texts with that id the one with the smallest digest. So unrelated
    texts of one id all stay, and so does one of near copies without ids. Of repeated rows
    one stays. Each different pair of an id and a wordless text stays once.
    """
    with_words, without = rooted(docs, id_col, text_col, words, share, bands, rows, seed, star_rounds)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")).alias("k")
    kept = with_words.groupBy("root").agg(first).select("k.id", "k.text_key").union(without.select("id", "text_key").distinct())
    kept = kept.select(F.col("id").alias("k_id"), F.col("text_key").alias("k_text"))
    whole = docs.select(F.struct("*").alias("row")).withColumn("id", F.col("row")[id_col].cast("long")).withColumn("key", text_key(F.col("row")[text_col]))
    same = whole["id"].eqNullSafe(kept["k_id"]) & (whole["key"] == kept["k_text"])
    return whole.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")
