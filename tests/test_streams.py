"""Streams give the batch answer, whatever the file sizes and their order."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from sigspark.operators.windows import segments
from sigspark.streaming.replay import follow, followed, replay_source, replay_windows
from sigspark.streaming.segments import SegmentProcessor, stream_segments


def test_segments_in_any_arrival_order(spark, tmp_path):
    rows = [(rec, i, i * 0.5, float(i * i % 7)) for rec, n in (("a", 1), ("b", 17), ("c", 30)) for i in range(1, n + 1)]
    signal = spark.createDataFrame(rows, "recording_id string, idx bigint, t double, v double")
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    for part in range(4):
        piece = spark.createDataFrame(mixed[part::4], signal.schema).coalesce(1)
        piece.write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay_source(spark, str(tmp_path / "in"), signal.schema, files_per_trigger=1)
    out = stream_segments(stream, size=8, path=str(tmp_path / "out"))
    want = segments(signal)
    assert out.count() == len(rows) and out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_replayed_windows_equal_the_batch_answer(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 3).cast("string").alias("recording_id"), F.timestamp_micros(F.col("id") * 150_000).alias("ts"),
        (F.col("id") % 11).cast("double").alias("v"),
    )
    for part in (2, 0, 3, 1):  # not in the order of time
        rows.where(F.floor(F.unix_micros("ts") / 7_500_000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay_source(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    out = replay_windows(stream, "1 second", str(tmp_path / "out"))
    want = rows.groupBy("recording_id", F.window("ts", "1 second").start.alias("start")).agg(
        F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max")
    )
    assert out.exceptAll(want).count() == 0 and out.count() == want.count()


def test_an_endless_replay_goes_on_and_counts_late_rows(spark, tmp_path):
    """Two runs over one checkpoint, files out of order: every row once, late ones told apart."""
    rows = [(str(k % 3), 1_000_000 * ((k * 37) % 120), float(k % 11)) for k in range(240)]
    schema = "recording_id string, us bigint, v double"
    to_ts = lambda df: df.select("recording_id", F.timestamp_micros("us").alias("ts"), "v")
    batches = [rows[:60], rows[60:100], rows[100:200], rows[200:]]
    kinds = to_ts(spark.createDataFrame(rows[:1], schema)).schema
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen, late, past = {}, {}, -1
    for number, batch in enumerate(batches):
        to_ts(spark.createDataFrame(batch, schema)).coalesce(1).write.mode("append").parquet(source)
        if number in (1, 3):  # two runs, two files each
            follow(replay_source(spark, source, kinds, files_per_trigger=1), out, "10 seconds", available_now=True).awaitTermination()
    for batch in batches:
        for name, us, v in batch:
            key = name, us // 10_000_000
            seen.setdefault(key, []).append(v)
            late[key] = late.get(key, 0) + ((key[1] + 1) * 10 + 20 <= past)
        past = max(past, max(us for _, us, _ in batch) // 1_000_000)
    found = followed(spark, out, "10 seconds", "20 seconds").withColumn("no", (F.unix_seconds("start") / 10).cast("bigint")).collect()
    got = {(r.recording_id, r.no): (r.n, r.v_min, r.v_max, r.n_late, r.closed) for r in found}
    assert got == {k: (len(v), min(v), max(v), late[k], (k[1] + 1) * 10 + 20 <= past) for k, v in seen.items()}
    assert sum(late.values()) > 10 and sum(r.n for r in found) == len(rows)


class _Waiting(dict):
    """The map state without a session."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


def test_short_recordings_are_joined_many_at_a_time():
    """One call for a group of chunks, in portions that cut recordings anywhere; only last samples wait on."""
    rows = [(f"r{k}", i, i * 0.5, float(i * k % 7)) for k in range(50) for i in range(1, 2 + k % 20)]
    mixed = [(name, (i - 1) // 8 + extra, i, t, v) for name, i, t, v in rows for extra in ((0, 1) if i % 8 == 0 else (0,))]
    random.Random(5).shuffle(mixed)
    frames = [pd.DataFrame(mixed[k : k + 40], columns=["recording_id", "chunk", "idx", "t", "v"]) for k in range(0, len(mixed), 40)]
    processor = SegmentProcessor(8, portion_rows=200)
    processor._waiting = _Waiting()
    out = list(processor.handleInputRows((3,), iter(frames), None))
    assert len(out) == 2 * -(-len(frames) // 5)
    got = sorted((r.recording_id, r.idx, r.t1, r.v1, None if pd.isna(r.t0) else (r.t0, r.v0)) for f in out for r in f.itertuples())
    value = {(name, i): (t, v) for name, i, t, v in rows}
    assert got == sorted((name, i, t, v, value.get((name, i - 1))) for name, i, t, v in rows)
    # A last sample waits in its chunk; one that fills its chunk waits as the next chunk's first.
    assert sorted(processor._waiting) == sorted((f"r{k}", (1 + k % 20) // 8, 1 + k % 20) for k in range(50))
