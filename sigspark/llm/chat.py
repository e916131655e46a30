"""Chat formatting by columnar byte assembly, with loss spans, and the way back."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role MIDDLE text CLOSE. Inside roles and texts the bytes of ESCAPED, with
#: which every mark begins, and the escape sign itself are written as three bytes.
OPEN, MIDDLE, CLOSE = b"<s>[", b"]\n", b"</s>\n"
ESCAPED = {b"%": b"%25", b"<": b"%3C", b"[": b"%5B", b"]": b"%5D"}
FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:int,stop:int>>"
#: Bytes of input turns assembled at a time; a longer conversation goes on in its next part.
PART_BYTES = 1 << 22


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contents, starts and lengths of a string column, without copying it."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)


def _escape(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same segments with every byte of ESCAPED as three bytes."""
    hit = np.isin(data, np.frombuffer(b"".join(ESCAPED), np.uint8))
    if not hit.any():
        return data, starts, sizes
    before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    grown = np.empty(len(data) + 2 * int(before[-1]), np.uint8)
    to = np.arange(len(data)) + 2 * before[:-1]
    grown[to[~hit]] = data[~hit]
    for sign, code in ESCAPED.items():
        place = to[data == sign[0]]
        for k in range(3):
            grown[place + k] = code[k]
    return grown, starts + 2 * before[starts], sizes + 2 * (before[starts + sizes] - before[starts])


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns as one buffer; per turn where it starts, and where its text starts and stops.

    Segment lengths give cumulative offsets, and these the scatter indices; headers and
    contents are copied into one preallocated array.
    """
    n = len(role)
    (r_data, r_at, r_n), (t_data, t_at, t_n) = (_escape(*_bytes_of(c)) for c in (role, text))
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    sizes = np.stack([np.full(n, len(OPEN)), r_n, np.full(n, len(MIDDLE)), t_n, np.full(n, len(CLOSE))], axis=1)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(int(at[-1]), np.uint8)
    begin = at[:-1].reshape(n, 5)
    for k, mark in zip((0, 2, 4), fixed):
        out[begin[:, k, None] + np.arange(len(mark))] = mark
    for k, data, start, size in ((1, r_data, r_at, r_n), (3, t_data, t_at, t_n)):
        shift = np.repeat(begin[:, k] - start, size)
        out[np.arange(len(data)) + shift] = data
    return out, begin[:, 0], begin[:, 3], begin[:, 4]


def _formatter(trained: str):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_pylist()
            role, text = batch.column("role").fill_null(""), batch.column("text").fill_null("")
            out, begin, start, stop = assemble(role, text)
            trains = np.array(role.to_pylist(), object) == trained
            # Code points before each byte place: all bytes but those that go on a character.
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            ends = np.append(begin[1:], len(out))
            spent = np.concatenate([[0], np.cumsum(ends - begin)])
            rows: list[tuple] = []
            k = 0
            while k < len(ids):
                stop_row = k + 1
                while stop_row < len(ids) and ids[stop_row] == ids[k] and spent[stop_row + 1] - spent[k] <= PART_BYTES:
                    stop_row += 1
                part = part + 1 if ids[k] == last else 0
                last = ids[k]
                zero = points[begin[k]]
                spans = [
                    {"start": int(points[start[i]] - zero), "stop": int(points[stop[i]] - zero)}
                    for i in range(k, stop_row) if trains[i]
                ]
                rows.append((ids[k], part, out[begin[k] : ends[stop_row - 1]].tobytes().decode(), spans))
                k = stop_row
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                ["conv_id", "part", "formatted", "loss"],
            )

    return parts


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(conv_id, part, formatted, loss)``: conversations in the template, in parts.

    Turns are put in order of ``turn``, then role and text, so ties have one order; nulls come
    first. A null role or text is empty. ``loss`` holds code point spans within the part, one per
    text of the ``trained`` role, marks left out. A conversation is one part unless a batch of
    rows ends within it or it is longer than ``PART_BYTES``; its parts in order are its text,
    and a task holds one batch at a time however long a conversation is. Turns without a
    conversation id form one conversation. Other columns are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_formatter(trained), FORMATTED)


def unescaped(text: str) -> str:
    for sign, code in reversed(ESCAPED.items()):  # the escape sign comes last
        text = text.replace(code.decode(), sign.decode())
    return text


def parsed(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn in formatted text."""
    turns = text.split(CLOSE.decode())
    assert turns.pop() == ""
    out = []
    for turn in turns:
        assert turn.startswith(OPEN.decode())
        role, _, said = turn[len(OPEN) :].partition(MIDDLE.decode())
        out.append((unescaped(role), unescaped(said)))
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, None
    for batch in itertools.chain(batches, [None]):
        done = []
        for row in [None] if batch is None else batch.to_pylist():
            if state is not None and (row is None or (row["part"] == 0)):
                turns, said, loss, chars, all_chars = state
                done.append((last, turns, said.hexdigest(), chars, loss.hexdigest(), all_chars))
                state = None
            if row is None:
                break
            if state is None:
                last, state = row["conv_id"], [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            for role, text in parsed(row["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescaped(row["formatted"][span["start"] : span["stop"]])
                state[2].update(text.encode())
                state[3] += len(text)
            state[4] += len(row["formatted"])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names)


def digests(conversations: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the formatted parts (``formatted``)."""
    # The parts of a conversation lie in one partition in order; this only makes sure of it.
    placed = conversations.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.mapInArrow(_digester, DIGESTS)
