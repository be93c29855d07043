"""Inventory sources: directory scans, hashes, header detection, archive listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.archives import read_members

# Detectors in order: type, least length, bytes to skip, header id, place of the magic bytes, these in hex.
DETECTORS = [
    ("ZIP", 22, 0, None, 0, "504b0304"),
    ("GZ", 18, 0, None, 0, "1f8b08"),
    ("SevenZip", 6, 0, None, 0, "377abcaf271c"),
    ("RAR", 6, 0, None, 0, "526172211a07"),
    ("CHD", 76, 0, None, 0, "4d436f6d70724844"),
    ("A7800", 128, 128, "a7800.xml", 1, "415441524937383030"),
    ("A7800", 128, 128, "a7800.xml", 100, "41435455414c20434152542044415441205354415254532048455245"),
    ("A7800", 128, 128, "No-Intro_A7800.xml", 1, "415441524937383030"),
    ("A7800", 128, 128, "No-Intro_A7800.xml", 100, "41435455414c20434152542044415441205354415254532048455245"),
    ("FDS", 16, 16, "fds.xml", 0, "4644531a010000000000000000000000"),
    ("FDS", 16, 16, "fds.xml", 0, "4644531a020000000000000000000000"),
    ("FDS", 16, 16, "fds.xml", 0, "4644531a030000000000000000000000"),
    ("FDS", 16, 16, "fds.xml", 0, "4644531a040000000000000000000000"),
    ("FDS", 16, 16, "No-Intro_FDS.xml", 0, "464453"),
    ("Lynx", 64, 64, "lynx.xml", 0, "4c594e58"),
    ("Lynx", 64, 64, "lynx.xml", 6, "425339"),
    ("Lynx", 64, 64, "No-Intro_LNX.xml", 0, "4c594e58"),
    ("Lynx", 64, 64, "No-Intro_LNX.xml", 6, "425339"),
    ("NES", 16, 16, "No-Intro_NES.xml", 0, "4e45531a"),
    ("NES", 16, 16, "NonGoodNES.xml", 0, "4e45531a"),
    ("NES", 16, 16, "nes.xml", 0, "4e45531a"),
    ("NES", 16, 16, "nes0.xml", 0, "4e45531a"),
    ("PCE", 512, 512, "pce.xml", 0, "4000000000000000aabb02"),
    ("PSID", 118, 118, "psid.xml", 0, "5053494400010076"),
    ("PSID", 118, 118, "psid.xml", 0, "505349440003007c"),
    ("PSID", 124, 124, "psid.xml", 0, "505349440002007c"),
    ("PSID", 124, 124, "psid.xml", 0, "505349440001007c"),
    ("PSID", 124, 124, "psid.xml", 0, "525349440002007c"),
    ("SNES", 512, 512, "snes.xml", 22, "aabb040000000000"),
    ("SNES", 512, 512, "snes.xml", 22, "535550455255464f"),
    ("SPC", 256, 256, "spc.xml", 0, "534e45532d535043"),
]


def scan_directory(spark: SparkSession, path: str, ignore: str | None = None) -> DataFrame:
    """(path, name, size, mtime, content) of all files below path, without ignored names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return out.where(~F.col("name").rlike(ignore)) if ignore else out


def hashes(content: Column, prefix: str = "") -> list[Column]:
    return [
        F.length(content).cast("long").alias(f"{prefix}size"),
        F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0").alias(f"{prefix}crc"),
        F.md5(content).alias(f"{prefix}md5"),
        F.sha1(content).alias(f"{prefix}sha1"),
        F.sha2(content, 256).alias(f"{prefix}sha256"),
    ]


def detect_header(content: Column, detectors: list[tuple] = DETECTORS) -> Column:
    """struct(type, skip) of the first detector whose magic bytes are there; a file must be longer than the header.
    All types can be found, those with long headers too."""
    out = F.lit(None).cast("struct<type:string,skip:int>")
    for kind, least, skip, _, at, magic in reversed(detectors):
        hit = (F.length(content) > least) & (F.lower(F.hex(F.substring(content, at + 1, len(magic) // 2))) == magic)
        out = F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(skip).alias("skip"))).otherwise(out)
    return out


def scan_hashes(files: DataFrame) -> DataFrame:
    """files(content, ...) with all hashes, the header, and the hashes of what follows it."""
    found = files.withColumn("header", detect_header(F.col("content")))
    rest = F.when(F.col("header.skip") > 0, F.substring(F.col("content"), F.col("header.skip") + 1, F.length("content")))
    return found.select("*", *hashes(F.col("content")), *hashes(rest, "alt_"))


def list_archives(files: DataFrame) -> DataFrame:
    """files(path, content): one row a member of each zip or 7z archive, in the order of its directory, nothing unpacked.
    got_status is Corrupt for what isn't a whole archive (one row without a name)."""
    return read_members(files, deep=False).select("path", "place", "name", "size", "crc", "is_directory", "header_offset", "got_status")


# Places (from 0) of the fields of disk image headers, by version: length, MD5, MD5 of the parent, SHA1,
# raw SHA1, SHA1 of the parent.
DISK_HEADERS = {
    1: (76, 44, 60, None, None, None),
    2: (80, 44, 60, None, None, None),
    3: (120, 44, 60, None, 80, 100),
    4: (108, None, None, 48, 88, 68),
    5: (124, None, None, 84, 64, 104),
}
ALTERNATE_TYPES = ("A7800", "FDS", "Lynx", "NES", "PCE", "PSID", "SNES", "SPC")


def header_type(header_id: Column) -> Column:
    """The type of header that a catalog's header attribute names, in any case; null if none."""
    named = {d[3].lower(): d[0] for d in DETECTORS if d[3]}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), F.lower(header_id))


def has_alternates(kind: Column) -> Column:
    """Files of these types have hashes of what follows the header."""
    return F.coalesce(kind.isin(*ALTERNATE_TYPES), F.lit(False))


def disk_header(content: Column) -> Column:
    """struct(version, sha1, md5, needs_parent) of a disk image, from its header alone; null for anything else. The SHA1
    is the image's, or else that of the raw data; hashes of zeros are unknown."""
    number = lambda at: F.conv(F.hex(F.substring(content, at + 1, 4)), 16, 10).cast("int")
    out = F.lit(None).cast("struct<version:int,sha1:string,md5:string,needs_parent:boolean>")

    def field(at: int | None, n: int) -> Column:
        value = F.lit(None).cast("string") if at is None else F.lower(F.hex(F.substring(content, at + 1, n)))
        return F.when(value != "0" * (2 * n), value)

    for version, (length, md5, parent_md5, sha1, raw, parent) in DISK_HEADERS.items():
        found = F.struct(
            F.lit(version).alias("version"), F.coalesce(field(sha1, 20), field(raw, 20)).alias("sha1"), field(md5, 16).alias("md5"),
            (field(parent_md5, 16).isNotNull() | field(parent, 20).isNotNull()).alias("needs_parent"),
        )
        out = F.when((number(12) == version) & (number(8) == length) & (F.length(content) >= length), found).otherwise(out)
    return F.when(F.substring(content, 1, 8) == F.lit(b"MComprHD"), out)


def gzip_member(content: Column) -> Column:
    """struct(size, crc) of a gzip file's only member, by its last eight bytes (sizes wrap at 4 GiB); null if it is none."""
    last = lambda at: F.reverse(F.array(*(F.hex(F.substring(content, F.length(content) - at + i, F.lit(1))) for i in range(1, 5))))
    found = F.struct(F.conv(F.array_join(last(4), ""), 16, 10).cast("long").alias("size"), F.lower(F.array_join(last(8), "")).alias("crc"))
    return F.when((F.substring(content, 1, 3) == F.lit(b"\x1f\x8b\x08")) & (F.length(content) >= 18), found)


def with_file_type(files: DataFrame) -> DataFrame:
    """files(name) with file_type by extension."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return files.withColumn("file_type", F.when(ext == "zip", "Zip").when(ext == "7z", "SevenZip").otherwise("File"))
