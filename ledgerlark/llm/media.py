"""Media columns: lossless 8-bit grey PNG images in binary columns, and perceptual hashes of what was stored.

A payload becomes an image of WIDTH samples a row. encode() filters rows as the PNG specification has it, compresses
them with zlib and cuts the stream into IDAT chunks, each with its CRC. decode() tests the signature, every chunk's
CRC, the header and zlib's own Adler-32, undoes all five row filters in numpy and returns the samples.
feature() is the sign pattern of the 8 x 8 lowest cosine-transform frequencies of the image scaled to 32 x 32, worked
in whole numbers, so equal samples give equal features on any machine.

Nulls and empty payloads: a null text counts as empty; an empty one becomes one row of zeros. Very long texts are
one image each; memory is a few times the longest text. Equal payloads give equal media and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
_SIDE, _LOW = 32, 8
_COSINES = np.rint(4096 * np.cos(np.pi * (2 * np.arange(_SIDE) + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))).astype(np.int64)


class MediaError(ValueError):
    """Stored bytes that are not a whole, undamaged image."""


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return payload + bytes(-len(payload) % WIDTH) if payload else bytes(WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(samples: np.ndarray, kind: int) -> np.ndarray:
    """Rows of samples under PNG filter 0 to 4, without the filter bytes."""
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    up = np.zeros_like(samples)
    up[1:] = samples[:-1]
    if kind == 0:
        return samples
    if kind == 1:
        return samples - left
    if kind == 2:
        return samples - up
    if kind == 3:
        return samples - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(samples)
    corner[1:, 1:] = samples[:-1, :-1]
    return samples - _paeth(left, up, corner)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    from_a, from_b, from_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((from_a <= from_b) & (from_a <= from_c), left, np.where(from_b <= from_c, up, corner))


def encode(payload: bytes, level: int = 1, kinds: tuple[int, ...] = (0, 1, 2)) -> bytes:
    """payload (a positive multiple of WIDTH long) as PNG, under that filter of kinds with the least absolute sum."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.empty((len(samples), WIDTH + 1), np.uint8)
    tries = [(int(np.abs(x.view(np.int8).astype(np.int16)).sum(dtype=np.int64)), k, x) for k in kinds for x in [filtered(samples, k)]]
    _, rows[:, 0], rows[:, 1:] = min(tries, key=lambda x: x[:2])
    packed = zlib.compress(rows, level)
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", header)]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def decode(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image, after all tests of its form; MediaError if one fails."""
    if media[:8] != SIGNATURE:
        raise MediaError("signature")
    at, size, stream, ended = 8, None, [], False
    while at < len(media):
        if ended or at + 12 > len(media):
            raise MediaError("chunks")
        (length,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + length]
        if len(body) < length or at + 12 + length > len(media):
            raise MediaError("cut off")
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"CRC of {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
                raise MediaError("not plain 8-bit grey")
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise MediaError("no header or end")
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size[1] * (size[0] + 1):
        raise MediaError("length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1))


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undo the filters, whole runs of rows of one kind at once: running sums along rows (1) or columns (2), and
    diagonal by diagonal where a sample needs its neighbours' sums first (3, 4)."""
    kinds, body = rows[:, 0], rows[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise MediaError("filter")
    out = np.zeros((len(rows) + 1, body.shape[1]), np.uint8)  # row 0: the zeros above the image
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)] if len(rows) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part, kind = body[a:b], int(kinds[a])
        if kind == 0:
            out[a + 1 : b + 1] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[a + 1 : b + 1])
        elif kind == 2:
            out[a + 1 : b + 1] = np.cumsum(part, axis=0, dtype=np.uint8) + out[a]
        else:
            _diagonals(out[a : b + 1], part, kind)
    return out[1:]


def _diagonals(out: np.ndarray, part: np.ndarray, kind: int) -> None:
    """out: the finished row above, then the rows to fill."""
    high, wide = part.shape
    framed = np.zeros((high + 1, wide + 1), np.uint8)  # one column of zeros on the left
    framed[0, 1:] = out[0]
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        left, up, corner = framed[y + 1, x], framed[y, x + 1], framed[y, x]
        guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == 3 else _paeth(left, up, corner)
        framed[y + 1, x + 1] = part[y, x] + guess
    out[1:] = framed[1:, 1:]


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest cosine frequencies lie above their median."""
    high, wide = samples.shape
    cols, rows = np.arange(_SIDE) * wide // _SIDE, np.arange(_SIDE) * high // _SIDE
    small = np.add.reduceat(samples, cols, axis=1, dtype=np.int64) * 256 // np.maximum(1, np.diff(cols, append=wide))
    if high >= _SIDE:
        small = np.add.reduceat(small, rows, axis=0) // np.diff(rows, append=high)[:, None]
    else:
        small = small[rows]
    low = (_COSINES @ small @ _COSINES.T).ravel()
    bits = low > np.sort(low[1:])[len(low[1:]) // 2]
    return np.packbits(bits).tobytes().hex()


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about limit bytes in their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[-1]) if isinstance(row[-1], (bytes, str)) else 0)
        if size > limit:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as a PNG in a binary column."""

    def rows(batches):
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                x = x or b""
                yield k, len(x), encode(pad(x))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: _batches(rows(batches), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()]), "doc_id long, n_bytes long, media binary"
    )


def decode_column(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the
    stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches):
        for b in batches:
            for k, n, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                samples = decode(m)
                payload = samples.tobytes()
                yield k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)

    return media.mapInArrow(
        lambda batches: _batches(rows(batches), names, types),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
