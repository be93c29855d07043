import hashlib
import io
import lzma
import struct
import zipfile
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlark.operators import planning
from ledgerlark.sources import archives, inventory


def zipped(members, claim=None, date=(1996, 12, 24, 23, 32, 0), extra=b""):
    """An archive of (name, content) with a comment that claims a structure."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            info = zipfile.ZipInfo(name, date)
            info.compress_type, info.extra = zipfile.ZIP_DEFLATED, extra
            z.writestr(info, content)
    raw = out.getvalue()
    if not claim:
        return raw
    size, at = struct.unpack_from("<II", raw, len(raw) - 10)
    comment = f"{archives.STRUCTURES[claim][0]}{zlib.crc32(raw[at : at + size]):08X}".encode()
    return raw[:-2] + struct.pack("<H", len(comment)) + comment


def zstd_zip(members, time=0):
    """An archive of (name, content, packed or None) by method 93."""
    body, directory = b"", b""
    for name, content, packed in members:
        packed = zstandard.compress(content) if packed is None else packed
        fields = struct.pack("<HHHHHIIIHH", 63, 0, 93, time & 0xFFFF, time >> 16, zlib.crc32(content), len(packed), len(content), len(name), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 0) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + name.encode()
        body += b"PK\x03\x04" + fields + name.encode() + packed
    comment = f"RVZSTD-{zlib.crc32(directory):08X}".encode()
    return body + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), len(body), len(comment)) + comment


def structures(spark, contents):
    files = spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(contents)], "path string, content binary")
    members = archives.read_members(files).withColumnRenamed("path", "archive")
    return [r.structure for r in planning.valid_structure(members).orderBy(F.col("archive").cast("int")).collect()]


def test_claimed_structures(spark):
    two = [("a.bin", b"abc"), ("b/c.bin", b"")]
    good = zipped(two, "ZipTrrnt")
    empty = bytes.fromhex(archives.EMPTY_ZSTD)
    cases = [
        (good, "ZipTrrnt"),
        (zipped(two), "None"),  # no claim
        (good[:-1] + (b"0" if good[-1:] != b"0" else b"1"), "None"),  # another CRC
        (b"x" + good, "None"),  # something before the archive
        (zipped(two, "ZipTrrnt", (2001, 2, 3, 4, 5, 6)), "None"),
        (zipped(two, "ZipTDC", (2001, 2, 3, 4, 5, 6)), "ZipTDC"),
        (zipped(two, "ZipDTD", (2001, 2, 3, 4, 5, 6)), "ZipDTD"),
        (zipped(two[::-1], "ZipTrrnt"), "None"),  # order
        (zipped([("A", b"1"), ("a", b"2")], "ZipTrrnt"), "None"),  # equal but for case
        (zipped([("B/", b""), ("b/c", b"1")], "ZipTrrnt"), "None"),  # a directory that b/c implies
        (zipped([("B/", b""), ("b/c", b"1")], "ZipTDC"), "ZipTDC"),
        (zipped([("b/", b""), ("c", b"1")], "ZipTrrnt"), "ZipTrrnt"),
        (zipped([("a\\b", b"1")], "ZipTrrnt"), "None"),
        (zipped([("a", b"1")], "ZipTrrnt", extra=struct.pack("<HHI", 0x7075, 4, 1)), "None"),
        (zipped([("日", b"1")], "ZipTrrnt"), "ZipTrrnt"),
        (zipped([("é", b"1")], "ZipTrrnt"), "None"),  # fits code page 437, so it must not be UTF-8
        (zstd_zip([("a", b"abc", None), ("b", b"", empty)]), "ZipZSTD"),
        (zstd_zip([("a", b"abc", None)], time=archives.FIXED_TIME), "None"),
        (zstd_zip([("b", b"", b"\0" * 9)]), "None"),
        (zstd_zip([("b", b"", empty[:6])]), "None"),
    ]
    assert structures(spark, [c for c, _ in cases]) == [s for _, s in cases]


def seven_zip(files, packed_header, coder="lzma", spoil=False):
    """A 7z archive of one folder with files (name, content), a directory d and an empty file e."""
    def number(n):
        return bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255]) if n < 1 << 14 else b"\xf0" + struct.pack("<I", n)

    raw = b"".join(c for _, c in files)
    chain = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]
    two = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]
    lzma1 = b"\x23\x03\x01\x01\x05" + bytes([93]) + struct.pack("<I", 1 << 16)
    packs = {
        "lzma": (lambda x: lzma.compress(x, lzma.FORMAT_RAW, filters=chain), lzma1),
        "lzma2": (lambda x: lzma.compress(x, lzma.FORMAT_RAW, filters=two), b"\x21\x21\x01\x08"),
        "copy": (lambda x: x, b"\x01\x00"),
        "zstd": (zstandard.compress, b"\x04\x04\xf7\x11\x01"),
        "other": (lambda x: x, b"\x03\x09\x09\x09"),
    }
    pack, method = packs[coder]
    body = pack(raw)
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\0"
    streams += b"\x07\x0b" + number(1) + b"\0" + number(1) + method + b"\x0c" + number(len(raw)) + b"\0"
    streams += b"\x08\x0d" + number(len(files)) + b"\x09" + b"".join(number(len(c)) for _, c in files[:-1])
    streams += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(c) ^ spoil) for _, c in files) + b"\0" + b"\0"
    names = [n for n, _ in files] + ["d", "e"]
    text = b"\0" + "".join(n + "\0" for n in names).encode("utf-16-le")
    bits = lambda x: bytes([sum(128 >> i for i, v in enumerate(x) if v)])
    times = b"\x01\0" + struct.pack("<Q", 132000000000000000) * len(names)
    info = b"\x05" + number(len(names))
    for kind, value in ((14, bits([False] * len(files) + [True, True])), (15, bits([False, True])), (17, text), (20, times)):
        info += number(kind) + number(len(value)) + value
    header = b"\x01\x04" + streams + info + b"\0" + b"\0"
    if packed_header:
        small = lzma.compress(header, lzma.FORMAT_RAW, filters=chain)
        packed = b"\x17\x06" + number(len(body)) + number(1) + b"\x09" + number(len(small)) + b"\0"
        packed += b"\x07\x0b" + number(1) + b"\0" + number(1) + lzma1 + b"\x0c" + number(len(header)) + b"\x0a\x01" + struct.pack("<I", zlib.crc32(header)) + b"\0\0"
        body, header = body + small, packed
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf'\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


@pytest.mark.parametrize("coder", ["lzma", "lzma2", "copy", "zstd", "other"])
@pytest.mark.parametrize("packed_header", [False, True])
def test_seven_zip(coder, packed_header):
    files = [("a.bin", b"NES\x1a" + bytes(300)), ("b/日.bin", b"text" * 100)]
    rows = list(archives.seven_zip_members(seven_zip(files, packed_header, coder), True))
    read = coder != "other"
    assert [(r[1], r[2], r[3], r[13], r[14]) for r in rows] == [(n, False, len(c), "Got", c if read else None) for n, c in files] + [("d/", True, 0, "Got", None), ("e", False, 0, "Got", b"")]
    assert [r[5] for r in rows[:2]] == [f"{zlib.crc32(c):08x}" for _, c in files] and rows[0][7] == 132000000000000000
    assert all(r[14] is None for r in archives.seven_zip_members(seven_zip(files, packed_header, coder), False) if r[3])
    if read:
        assert [r[13] for r in archives.seven_zip_members(seven_zip(files, packed_header, coder, spoil=True), True)] == ["Corrupt", "Corrupt", "Got", "Got"]


def test_members_of_any_bytes(spark):
    nes, good = b"NES\x1a" + bytes(12) + b"rom", [("b.bin", b"abc")]
    whole = zipped([("a.nes", nes), ("z.txt", b"")])
    bad = bytearray(zipped([("x.txt", b"some text" * 20)]))
    bad[40] ^= 0x55
    seven = seven_zip(good, True)
    rows = [("a", bytearray(whole)), ("b", bytearray(bad)), ("c", bytearray(seven)), ("d", bytearray(seven[:-1])), ("e", bytearray(b"")), ("f", None), ("g", bytearray(b"7z"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = inventory.scan_hashes(archives.read_members(files).drop("size", "crc")).orderBy("path", "place").collect()
    assert [(r.path, r.name, r.got_status) for r in got] == [
        ("a", "a.nes", "Got"), ("a", "z.txt", "Got"), ("b", "x.txt", "Corrupt"), ("c", "b.bin", "Got"), ("c", "d/", "Got"), ("c", "e", "Got"),
        ("d", None, "Corrupt"), ("e", None, "Corrupt"), ("f", None, "Corrupt"), ("g", None, "Corrupt"),
    ]
    assert got[0].header.type == "NES" and got[0].alt_sha1 == hashlib.sha1(b"rom").hexdigest() and got[0].sha256 == hashlib.sha256(nes).hexdigest()
    assert got[1].size == 0 and got[2].sha1 is None and got[3].md5 == hashlib.md5(b"abc").hexdigest()
    for cut in range(0, len(seven), 7):  # no damage does more than make an archive corrupt
        spoiled = bytearray(seven)
        spoiled[cut] ^= 0xFF
        try:
            list(archives.seven_zip_members(bytes(spoiled), True))
        except archives._DAMAGED:
            pass
