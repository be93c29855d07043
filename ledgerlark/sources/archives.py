"""Members of zip and 7z archives: their listings, their contents, and the structure that an archive claims to have.

An archive's bytes are read in one task, one archive after another; members leave it in batches of bounded size, so
hashes and headers of contents are worked out by column expressions (inventory.scan_hashes)."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Structures that an archive's comment can claim: comment (followed by the directory's CRC), method, dates.
STRUCTURES = {
    "ZipTrrnt": ("TORRENTZIPPED-", 8, "fixed"),
    "ZipTDC": ("TDC-", 8, "any"),
    "ZipDTD": ("DTD-", 8, "any"),
    "ZipZSTD": ("RVZSTD-", 93, "zero"),
    "ZipDTZ": ("DTZ-", 93, "any"),
}
# The packed time of all members under "fixed" dates, and the stream of an empty member under zstd.
FIXED_TIME = 563657728
EMPTY_ZSTD = "28b52ffd2000010000"

MEMBER = "place int, name string, is_directory boolean, size long, packed_size long, crc string, method int, dos_time long, utf8 boolean, header_offset long, header_ok boolean, packed_head binary, claimed string, got_status string, content binary"
_BATCH = 64 << 20
_DAMAGED = (zipfile.BadZipFile, NotImplementedError, EOFError, ValueError, IndexError, KeyError, RuntimeError, struct.error, zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError)


def _claim(content: bytes, comment: bytes) -> str | None:
    """The structure that the comment names, if the directory's CRC in it is right and nothing stands around the archive."""
    end = len(content) - 22 - len(comment)
    size, at = struct.unpack_from("<II", content, end + 12)
    until = end
    if 0xFFFFFFFF in (size, at):
        until = struct.unpack_from("<Q", content, end - 12)[0]
        size, at = struct.unpack_from("<QQ", content, until + 40)
    if content[end : end + 4] != b"PK\x05\x06" or at + size != until:
        return None
    crc = f"{zlib.crc32(content[at : at + size]):08X}"
    return next((kind for kind, (start, _, _) in STRUCTURES.items() if comment == (start + crc).encode()), None)


def _local(content: bytes, m: zipfile.ZipInfo, dos_time: int) -> tuple[bool, int]:
    """Whether a member's local header says what the directory says and neither holds extra fields, but for those of
    large sizes; and the place of its data."""
    sign, _, flags, method, time, date, crc, packed, size, n, extra = struct.unpack_from("<4s5H3I2H", content, m.header_offset)
    if sign != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header")
    start = m.header_offset + 30
    name = m.orig_filename.encode("utf-8" if m.flag_bits & 0x800 else "cp437")
    fields = lambda x: {struct.unpack_from("<H", x, 0)[0]} if len(x) >= 4 else set()
    large = 0xFFFFFFFF in (packed, size)
    same = (flags, method, date << 16 | time, crc) == (m.flag_bits, m.compress_type, dos_time, m.CRC) and content[start : start + n] == name
    sizes = large or (packed, size) == (m.compress_size, m.file_size)
    plain = fields(m.extra) | fields(content[start + n : start + n + extra]) <= {1}
    return same and sizes and plain and not (m.is_dir() and m.file_size), start + n + extra


def _unpacked(method: int, packed: bytes, size: int) -> bytes | None:
    """A member's content; null for methods that aren't read."""
    if method == 0:
        return packed
    if method == 8:
        return zlib.decompressobj(-15).decompress(packed)
    if method == 12:
        return bz2.decompress(packed)
    if method == 93:
        return zstandard.ZstdDecompressor().decompressobj().decompress(packed) if size else b""
    return None


def zip_members(content: bytes, deep: bool) -> Iterator[tuple]:
    """Rows as MEMBER has them, in the order of the central directory. A member whose content does not have its CRC and
    size is Corrupt."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        claimed = _claim(content, z.comment)
        for place, m in enumerate(z.infolist()):
            year, month, day, hour, minute, second = m.date_time
            dos_time = (year - 1980) << 25 | month << 21 | day << 16 | hour << 11 | minute << 5 | second // 2
            status, data, agrees, packed = "Got", None, False, b""
            try:
                agrees, start = _local(content, m, dos_time)
                packed = content[start : start + m.compress_size]
                if deep and not m.flag_bits & 1:
                    data = _unpacked(m.compress_type, packed, m.file_size)
                    if data is not None and (len(data), zlib.crc32(data)) != (m.file_size, m.CRC):
                        status, data = "Corrupt", None
            except _DAMAGED:
                status = "Corrupt"
            yield (place, m.filename, m.is_dir(), m.file_size, m.compress_size, f"{m.CRC:08x}", m.compress_type, dos_time, bool(m.flag_bits & 0x800), m.header_offset, agrees, packed[:9], claimed, status, data)


class _Reader:
    """Fields of a 7z header, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EOFError("7z header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading ones of the first byte say how many bytes follow; its other bits are the highest of the number."""
        first = self.byte()
        more = 8 - (first ^ 0xFF).bit_length()
        low = int.from_bytes(self.take(more), "little")
        return low | (first & ((1 << (7 - more)) - 1 if more < 7 else 0)) << (8 * more)

    def count(self) -> int:
        """A number of things that each need room in the rest of the header or of its bit fields."""
        if (n := self.number()) > 8 * len(self.data):
            raise ValueError("7z header counts more than it can hold")
        return n

    def bits(self, n: int) -> list[bool]:
        held = self.take(-(-n // 8))
        return [bool(held[i // 8] >> (7 - i % 8) & 1) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if has else None for has in self.defined(n)]


def _folder(r: _Reader) -> dict:
    coders, ins, outs = [], 0, 0
    for _ in range(r.count()):
        flags = r.byte()
        method = r.take(flags & 15)
        n_in, n_out = (r.count(), r.count()) if flags & 16 else (1, 1)
        coders.append((method.hex(), n_in, n_out, r.take(r.number()) if flags & 32 else b""))
        ins, outs = ins + n_in, outs + n_out
    binds = [(r.number(), r.number()) for _ in range(outs - 1)]
    n_packed = ins - len(binds)
    bound = {i for i, _ in binds}
    packed = [r.number() for _ in range(n_packed)] if n_packed > 1 else [i for i in range(ins) if i not in bound]
    return {"coders": coders, "binds": binds, "packed": packed, "outs": outs, "crc": None}


def _streams(r: _Reader) -> dict:
    """Places and sizes of packed streams, the folders, and for each folder the (size, crc) of its files."""
    at, packed, folders, parts = 0, [], [], None
    while kind := r.byte():
        if kind == 6:
            at, n = r.number(), r.count()
            while field := r.byte():
                if field == 9:
                    packed = [r.number() for _ in range(n)]
                else:
                    r.digests(n)
        elif kind == 7:
            while field := r.byte():
                if field == 11:
                    n, external = r.count(), r.byte()
                    if external:
                        raise NotImplementedError("7z folders kept elsewhere")
                    folders = [_folder(r) for _ in range(n)]
                elif field == 12:
                    for f in folders:
                        f["sizes"] = [r.number() for _ in range(f["outs"])]
                        last = set(range(f["outs"])) - {o for _, o in f["binds"]}
                        f["size"] = f["sizes"][min(last)]
                else:
                    for f, crc in zip(folders, r.digests(len(folders)), strict=True):
                        f["crc"] = crc
        elif kind == 8:
            counts, sizes = [1] * len(folders), None
            while field := r.byte():
                if field == 13:
                    counts = [r.count() for _ in folders]
                elif field == 9:
                    sizes = [[r.number() for _ in range(n - 1)] for n in counts]
                else:
                    parts = _parts(folders, counts, sizes)
                    unknown = [(i, j) for i, f in enumerate(folders) for j in range(counts[i]) if counts[i] != 1 or f["crc"] is None]
                    for (i, j), crc in zip(unknown, r.digests(len(unknown)), strict=True):
                        parts[i][j] = (parts[i][j][0], crc)
            parts = parts or _parts(folders, counts, sizes)
    return {"at": at, "packed": packed, "folders": folders, "parts": parts or _parts(folders, [1] * len(folders), None)}


def _parts(folders: list[dict], counts: list[int], sizes: list[list[int]] | None) -> list[list[tuple]]:
    """(size, crc) of the files of each folder; the last one's size is what the others leave."""
    out = []
    for i, (f, n) in enumerate(zip(folders, counts, strict=True)):
        first = sizes[i] if sizes else []
        out.append([(s, None) for s in first] + [(f["size"] - sum(first), f["crc"] if n == 1 else None)] if n else [])
    return out


def _decoded(content: bytes, streams: dict, which: int) -> bytes | None:
    """What a folder unpacks to; null if a coder isn't read."""
    folders = streams["folders"]
    f, before = folders[which], sum(len(x["packed"]) for x in folders[:which])
    if len(f["packed"]) != 1 or any(c[1:3] != (1, 1) for c in f["coders"]):
        return None
    start = 32 + streams["at"] + sum(streams["packed"][:before])
    data, at, follows = content[start : start + streams["packed"][before]], f["packed"][0], {o: i for i, o in f["binds"]}
    for _ in f["coders"]:
        method, _, _, props = f["coders"][at]
        size = f["sizes"][at]
        if method == "030101":
            lc, rest = props[0] % 9, props[0] // 9
            chain = [{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": rest % 5, "pb": rest // 5, "dict_size": max(4096, struct.unpack("<I", props[1:5])[0])}]
            data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(data, size)
        elif method == "21":
            chain = [{"id": lzma.FILTER_LZMA2, "dict_size": min((2 | props[0] & 1) << (props[0] // 2 + 11), 0xFFFFFFFF)}]
            data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(data, size)
        elif method == "04f71101":
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(size)
        elif found := {"00": 0, "040108": 8, "040202": 12}.get(method):
            data = _unpacked(found, data, size)
        elif method != "00":
            return None
        if at not in follows:
            return data
        at = follows[at]
    raise ValueError("7z coders form a ring")


def _files(r: _Reader) -> dict:
    n = r.count()
    out = {"names": [""] * n, "empty": [False] * n, "file": None, "times": [None] * n}
    while kind := r.number():
        part = _Reader(r.take(r.number()))
        if kind == 14:
            out["empty"] = part.bits(n)
        elif kind == 15:
            out["file"] = part.bits(sum(out["empty"]))
        elif kind == 17 and not part.byte():
            out["names"] = part.take(len(part.data) - 1).decode("utf-16-le").split("\0")[:n]
        elif kind == 20:
            has = part.defined(n)
            out["times"] = [struct.unpack("<Q", part.take(8))[0] if x else None for x in has] if not part.byte() else out["times"]
    return out


def seven_zip_members(content: bytes, deep: bool) -> Iterator[tuple]:
    """Rows as MEMBER has them. Directories end in a slash. Members of folders whose coders aren't read are listed without
    content; those that do not have their CRC are Corrupt."""
    if content[:6] != b"7z\xbc\xaf'\x1c" or len(content) < 32:
        raise ValueError("no 7z archive")
    at, size, crc = struct.unpack_from("<QQI", content, 12)
    header = content[32 + at : 32 + at + size]
    if zlib.crc32(content[12:32]) != struct.unpack_from("<I", content, 8)[0] or len(header) != size or zlib.crc32(header) != crc:
        raise ValueError("7z header is damaged")
    while header[:1] == b"\x17":
        r = _Reader(header)
        r.byte()
        header = _decoded(content, _streams(r), 0)
        if header is None:
            raise NotImplementedError("7z header's coder isn't read")
    streams, files, r = {"folders": [], "parts": []}, {"names": [], "empty": [], "file": None, "times": []}, _Reader(header)
    r.at = min(1, len(header))
    while r.at < len(header) and (kind := r.byte()):
        if kind == 2:
            while r.number():
                r.take(r.number())
        elif kind in (3, 4):
            found = _streams(r)
            streams = found if kind == 4 else streams
        elif kind == 5:
            files = _files(r)
    stored = iter([(i, j) for i, part in enumerate(streams["parts"]) for j in range(len(part))])
    n_empty, open_folder, data, offset = 0, -1, None, 0
    for place, (name, empty, time) in enumerate(zip(files["names"], files["empty"], files["times"], strict=True)):
        if empty:
            folder = not (files["file"] and files["file"][n_empty])
            n_empty += 1
            yield (place, name if not folder or name.endswith("/") else name + "/", folder, 0, 0, "00000000", None, time, True, None, True, b"", None, "Got", b"" if deep and not folder else None)
            continue
        i, j = next(stored)
        if i != open_folder:
            open_folder, offset = i, 0
            try:
                data, broken = (_decoded(content, streams, i) if deep else None), False
            except _DAMAGED:
                data, broken = None, True
        size, crc = streams["parts"][i][j]
        own = None if data is None else data[offset : offset + size]
        offset += size
        bad = broken or own is not None and (len(own) != size or crc is not None and zlib.crc32(own) != crc)
        yield (place, name, False, size, None, None if crc is None else f"{crc:08x}", None, time, True, None, True, b"", None, "Corrupt" if bad else "Got", None if bad else own)


def read_members(files: DataFrame, deep: bool = True) -> DataFrame:
    """files(path, content): one row a member of each zip or 7z archive (by its first bytes), in the order of its
    directory; with `deep`, contents are unpacked and held against their CRC. dos_time is the packed time of zip members
    and the file time (100 ns since 1601) of 7z members. What is no whole archive is one row without a name, Corrupt; null
    contents too. Content is null for directories of 7z archives, encrypted members and methods that aren't read.
    scan_hashes() of the result gives hashes, headers and the hashes behind them."""
    names = [x.split()[0] for x in MEMBER.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([("path", pa.string()), *((x.split()[0], kinds[x.split()[1]]) for x in MEMBER.split(", "))])
    corrupt = tuple({"place": 0, "is_directory": False, "header_ok": False, "utf8": False, "got_status": "Corrupt"}.get(x) for x in names)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = content.as_py() or b""
                reader = seven_zip_members if whole[:2] == b"7z" else zip_members
                try:
                    for row in reader(whole, deep):
                        rows.append((path, *row))
                        held += 256 + len(row[-1] or b"")
                        if held > _BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                except _DAMAGED:
                    rows.append((path, *corrupt))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, " + MEMBER)
