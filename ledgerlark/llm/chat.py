"""Chat formatting by columnar byte assembly.

A conversation becomes one text: for each turn `<|turn|>`, the role, `<|text|>`, the text, `<|end|>`. Inside roles and
texts, `<` that is followed by any number of backslashes and `|` gets one more backslash, so no control string can occur
there, and taking one off restores the original. The loss mask covers the texts of assistant turns, as spans of bytes.

The bytes of a batch of turns are laid out in numpy: segment lengths (header, role, separator, text, footer), their
running sum as offsets, scatter indices per kind of segment, and one preallocated buffer that becomes the Arrow column.

Order: turns are range-sorted by (conv_id, turn, role, text), so a conversation with a third of all rows is spread over
many tasks; each task assembles its run of turns of a conversation into segments, and only these few segments a
conversation are brought together. Equal turns are ordered by role, then text; null turns come first; null roles and
texts count as empty; a null conv_id is a conversation of its own. Empty table: no rows. Only the four columns are read.
The output of one conversation is one value and so must fit a task's memory; its parts are joined there in order.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = b"<|turn|>", b"<|text|>", b"<|end|>"
LOSS_ROLE = b"assistant"
_TURN = re.compile(re.escape(HEAD) + rb"(.*?)" + re.escape(MIDDLE) + rb"(.*?)" + re.escape(TAIL), re.DOTALL)
_ESCAPED = re.compile(rb"<(\\*)\\\|")
_TURNS_A_SEGMENT, _BYTES_A_SEGMENT = 4096, 4 << 20


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text) if b"<\\" in text else text


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns in one buffer: (bytes, offsets of the turns, spans of the texts as (start, end))."""
    (role, role_at), (text, text_at) = _buffer(escape(roles)), _buffer(escape(texts))
    n, role_n, text_n = len(roles), np.diff(role_at), np.diff(text_at)
    fixed = len(HEAD) + len(MIDDLE) + len(TAIL)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(fixed + role_n + text_n, out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    role_to = offsets[:-1] + len(HEAD)
    middle_to = role_to + role_n
    text_to = middle_to + len(MIDDLE)
    tail_to = text_to + text_n
    for mark, to in ((HEAD, offsets[:-1]), (MIDDLE, middle_to), (TAIL, tail_to)):
        out[to[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for data, at, length, to in ((role, role_at, role_n, role_to), (text, text_at, text_n, text_to)):
        first = int(at[0]) if n else 0
        out[np.arange(int(length.sum())) + np.repeat(to - (at[:-1] - first), length)] = data[first : first + int(length.sum())]
    return out, offsets, np.stack([text_to, tail_to], axis=1)


_SEGMENT = "conv_id long, task int, nth long, n_turns long, bytes binary, loss binary"


def _segments(turns: DataFrame) -> DataFrame:
    """turns: sorted by conversation and order within partitions."""
    names = ["conv_id", "task", "nth", "n_turns", "bytes", "loss"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        task, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            lengths = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:  # pieces of bounded bytes, one row at least
                before = lengths[at - 1] if at else 0
                n = min(_TURNS_A_SEGMENT, max(1, int(np.searchsorted(lengths, before + _BYTES_A_SEGMENT)) - at))
                part = b.slice(at, n)
                at += n
                conv = part.column(0).to_pylist()
                data, offsets, spans = assemble(part.column(1), part.column(2))
                masked = pc.equal(part.column(1), LOSS_ROLE.decode()).to_numpy(zero_copy_only=False)
                cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
                rows = []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    loss = spans[i:j][masked[i:j]] - offsets[i]
                    rows.append((conv[i], task, nth, j - i, data[offsets[i] : offsets[j]].tobytes(), loss.astype("<i8").tobytes()))
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return turns.mapInArrow(run, _SEGMENT)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss binary): loss holds the spans (start, end) of bytes under the loss mask, as
    little-endian 64-bit numbers."""
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    sorted_turns = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    whole = _segments(sorted_turns).repartition("conv_id").sortWithinPartitions("conv_id", "task", "nth")

    def run(batches):
        none = object()
        conv, parts, spans, size = none, [], [], 0

        def done():
            text = pa.array([b"".join(parts)], pa.binary()).cast(pa.string())
            loss = np.concatenate(spans) if spans else np.empty(0, "<i8")
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), text, pa.array([loss.astype("<i8").tobytes()], pa.binary())], ["conv_id", "formatted", "loss"])

        for b in batches:
            for of, data, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "bytes", "loss")), strict=True):
                if of != conv or conv is none:
                    if conv is not none:
                        yield done()
                    conv, parts, spans, size = of, [], [], 0
                parts.append(data)
                spans.append(np.frombuffer(loss, "<i8") + size)
                size += len(data)
        if conv is not none:
            yield done()

    return whole.mapInArrow(run, "conv_id long, formatted string, loss binary")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn, unescaped; ValueError if the text is not wholly made of turns."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted texts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                turns = parse(data)
                digest, masked, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    digest.update(role + b"\n" + said + b"\n")
                for a, z in np.frombuffer(loss, "<i8").reshape(-1, 2).tolist():
                    said = unescape(data[a:z])
                    masked.update(said)
                    chars += len(said.decode())
                rows.append((conv, len(turns), digest.hexdigest(), chars, masked.hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
