"""Views of the driver's tables as catalogs and inventories. The SQL is one text for both engines, but for one function."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INV = """
    SELECT doc_id AS node_id, source || '/' || lang AS parent_id, source AS set_name, lang,
        'd' || CAST(doc_id % 50 AS STRING) || CASE WHEN doc_id % 9 = 0 THEN '.BIN' ELSE '.bin' END AS name,
        CASE WHEN doc_id % 6 = 5 THEN 'File' ELSE 'FileZip' END AS file_type,
        CAST({octets} AS BIGINT) AS size, substr(md5(text), 1, 8) AS crc,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha1(text) END AS sha1,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS md5,
        CASE doc_id % 4 WHEN 0 THEN 'InToSort' WHEN 1 THEN 'InDatCollect' WHEN 2 THEN 'NotInDat' ELSE 'InDatMerged' END AS dat_status,
        CASE WHEN doc_id % 41 = 0 THEN 'Corrupt' ELSE 'Got' END AS got_status,
        CASE WHEN doc_id % 4 = 0 THEN 'staging' ELSE 'collection' END AS root_kind,
        doc_id % 2 = 0 AS sha1_verified, doc_id % 3 = 0 AS md5_verified, doc_id % 11 = 0 AS locked,
        doc_id % 13 = 0 AS mia, source IN ('src1', 'src3', 'src5') AS complete_only, doc_id AS ord,
        CASE WHEN doc_id % 8 = 3 THEN CAST({octets} AS BIGINT) - 16 END AS alt_size, CASE WHEN doc_id % 8 = 3 THEN substr(md5('alt' || text), 1, 8) END AS alt_crc,
        CASE WHEN doc_id % 8 = 3 AND doc_id % 5 <> 1 THEN sha1('alt' || text) END AS alt_sha1, CASE WHEN doc_id % 24 = 3 THEN md5('alt' || text) END AS alt_md5,
        doc_id % 16 = 3 AND doc_id % 5 <> 1 AS alt_sha1_verified, doc_id % 48 = 3 AS alt_md5_verified,
        CASE WHEN doc_id % 8 = 3 THEN 'NES' WHEN doc_id % 40 = 1 THEN 'Lynx' END AS header_type, false AS header_required, doc_id % 3 <> 1 AS header_from_file
    FROM {documents}
    UNION ALL
    SELECT 5000000 + doc_id, source || '/' || lang, source, lang, CASE WHEN doc_id % 2 = 0 THEN 'sheet.cue' ELSE 'void.bin' END, 'FileZip',
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(0 AS BIGINT) END, '00000000', CASE WHEN doc_id % 2 = 0 THEN 'da39a3ee5e6b4b0d3255bfef95601890afd80709' END, NULL,
        CASE doc_id % 4 WHEN 0 THEN 'InToSort' WHEN 1 THEN 'InDatCollect' WHEN 2 THEN 'NotInDat' ELSE 'InDatMerged' END, CASE WHEN doc_id % 5 = 0 THEN 'Corrupt' ELSE 'Got' END,
        CASE WHEN doc_id % 4 = 0 THEN 'staging' ELSE 'collection' END, false, false, doc_id % 7 = 0, false, source IN ('src1', 'src3', 'src5'), doc_id,
        NULL, NULL, NULL, NULL, false, false, NULL, false, false
    FROM {documents} WHERE doc_id % 11 = 0
    UNION ALL
    SELECT 6000000 + doc_id, source || '/' || lang, source, lang, 'c' || CAST(doc_id % 50 AS STRING) || '.cue', 'File',
        CAST({octets} AS BIGINT), substr(md5(text), 1, 8), NULL, NULL, CASE WHEN doc_id % 2 = 0 THEN 'InToSort' ELSE 'NotInDat' END, 'Got',
        CASE WHEN doc_id % 2 = 0 THEN 'staging' ELSE 'collection' END, false, false, false, false, false, doc_id,
        NULL, NULL, NULL, NULL, false, false, NULL, false, false
    FROM {documents} WHERE doc_id % 17 = 0
"""
CAT = """
    SELECT 1000000 + doc_id AS node_id, source || '/' || lang AS parent_id, source AS set_name, lang,
        'd' || CAST(doc_id % 50 AS STRING) || '.bin' AS name,
        CASE WHEN doc_id % 6 = 5 THEN 'File' ELSE 'FileZip' END AS file_type,
        CAST({octets} AS BIGINT) AS size,
        CASE WHEN doc_id % 4 = 1 THEN NULL ELSE substr(md5(text), 1, 8) END AS crc,
        CASE WHEN doc_id % 10 = 1 THEN NULL ELSE sha1(text) END AS sha1, md5(text) AS md5,
        'InDatCollect' AS dat_status, 'NotGot' AS got_status, 'collection' AS root_kind,
        false AS sha1_verified, false AS md5_verified, doc_id % 11 = 1 AS locked,
        doc_id % 13 = 0 AS mia, source IN ('src1', 'src3', 'src5') AS complete_only, doc_id AS ord,
        CAST(NULL AS BIGINT) AS alt_size, CAST(NULL AS STRING) AS alt_crc, CAST(NULL AS STRING) AS alt_sha1, CAST(NULL AS STRING) AS alt_md5,
        false AS alt_sha1_verified, false AS alt_md5_verified, CASE WHEN doc_id % 40 = 1 THEN 'NES' END AS header_type, doc_id % 31 = 1 AS header_required, false AS header_from_file
    FROM {documents} WHERE doc_id % 3 <> 0
    UNION ALL
    SELECT 2000000 + doc_id, source || '/' || lang, source, lang, 'x' || CAST(doc_id % 50 AS STRING) || '.bin', 'FileZip',
        CAST(7 AS BIGINT), substr(md5('x' || text), 1, 8), sha1('x' || text), md5('x' || text),
        'InDatCollect', 'NotGot', 'collection', false, false, false, doc_id % 17 = 0, source IN ('src1', 'src3', 'src5'), doc_id,
        NULL, NULL, NULL, NULL, false, false, NULL, false, false
    FROM {documents} WHERE doc_id % 19 = 0
    UNION ALL
    SELECT 3000000 + doc_id, source || '/' || lang, source, lang, 'h' || CAST(doc_id % 50 AS STRING) || '.nes', 'FileZip',
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST({octets} AS BIGINT) - 16 END, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE substr(md5('alt' || text), 1, 8) END,
        CASE WHEN doc_id % 7 = 1 THEN sha1('other' || text) ELSE sha1('alt' || text) END, md5('alt' || text),
        'InDatCollect', 'NotGot', 'collection', false, false, false, false, false, doc_id,
        NULL, NULL, NULL, NULL, false, false, CASE WHEN doc_id % 9 = 4 THEN 'Lynx' ELSE 'NES' END, doc_id % 2 = 0 OR doc_id % 5 = 1, false
    FROM {documents} WHERE doc_id % 8 = 3
    UNION ALL
    SELECT 4000000 + doc_id, source || '/' || lang, source, lang, CASE doc_id % 4 WHEN 0 THEN 'dir/' WHEN 1 THEN '/' ELSE 'zero.bin' END, 'FileZip',
        CASE WHEN doc_id % 4 < 2 THEN NULL ELSE CAST(0 AS BIGINT) END, CASE WHEN doc_id % 8 = 7 THEN substr(md5('zero' || text), 1, 8) END, NULL, NULL,
        'InDatCollect', 'NotGot', 'collection', false, false, doc_id % 9 = 0, false, false, doc_id,
        NULL, NULL, NULL, NULL, false, false, NULL, false, false
    FROM {documents} WHERE doc_id % 13 = 5
"""
SETS = """
    SELECT lang AS cat_id, 's' || CAST(doc_id AS STRING) AS name,
        CASE WHEN doc_id >= 10 THEN 's' || CAST(CAST(floor(doc_id / 10) AS BIGINT) AS STRING) END AS parent,
        CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 40 AS STRING) END AS id,
        CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 30 AS STRING) END AS cloneof_id,
        CAST(NULL AS STRING) AS cloneof, doc_id % 100 = 7 AS is_bios, doc_id AS ord
    FROM {documents}
"""
ITEMS = """
    SELECT lang AS cat_id, 's' || CAST(doc_id AS STRING) AS set_name, doc_id AS item_id, doc_id AS ord,
        CASE WHEN doc_id % 4 = 0 THEN 'sub/dir/' WHEN doc_id % 4 = 1 THEN 'sub/' ELSE '' END || 'f' || CAST(doc_id % 20 AS STRING) || '.rom' AS name,
        CASE WHEN doc_id % 15 = 4 THEN NULL ELSE CAST(doc_id % 8 AS BIGINT) END AS size, CASE WHEN doc_id % 14 = 3 THEN NULL ELSE substr(md5(CAST(doc_id % 8 AS STRING)), 1, 8) END AS crc,
        CASE WHEN doc_id % 6 = 0 THEN NULL ELSE sha1(CAST(doc_id % 8 AS STRING)) END AS sha1,
        CASE WHEN doc_id % 23 = 0 THEN 'nodump' WHEN doc_id % 5 = 0 THEN 'deduped' END AS status, doc_id % 12 = 11 AS is_disk
    FROM {documents}
"""
MEMBERS = """
    SELECT conv_id AS archive, turn AS place,
        CASE WHEN turn % 3 = 2 THEN 'dir/' WHEN turn % 5 = 4 THEN 'a\\b' ELSE 'dir/' || substr(md5(coalesce(text, '')), 1, 1) END AS name,
        CAST(length(coalesce(text, '')) AS BIGINT) AS size, sha1(coalesce(text, '')) AS sha1
    FROM {conversations}
"""


def duck(view: str) -> str:
    """The view's text for DuckDB."""
    return view.replace("{octets}", "octet_length(encode(text))").replace("{documents}", "documents").replace("{conversations}", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view's rows from the tables of sf_dir."""
    used = {n: table(spark, sf_dir, n) for n in ("documents", "conversations") if f"{{{n}}}" in text}
    return spark.sql(text.replace("{octets}", "octet_length(text)").replace("\\", "\\\\"), **used)


def _zip(number: int, text: bytes) -> bytes:
    """An archive of a document; its number says which rule of the structure that it claims it breaks, if any."""
    kind, out = number % 10, io.BytesIO()
    names = ["a/text", "B"] if kind != 1 else ["B", "a/text"]
    names = {2: ["a/", "a/text"], 3: ["a\\b", "c"], 4: ["A", "a"]}.get(kind, names)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if kind == 5 else zipfile.ZIP_DEFLATED) as z:
        for name, content in zip(names, [b"" if kind == 2 else text, text[::-1]], strict=True):
            info = zipfile.ZipInfo(name, (1996, 12, 24, 23, 32, 0) if kind != 6 else (2001, 2, 3, 4, 5, 6))
            info.compress_type = z.compression
            z.writestr(info, content, compresslevel=1)
    raw = out.getvalue()
    size, at = struct.unpack_from("<II", raw, len(raw) - 10)
    claim = "TDC-" if kind == 7 else "TORRENTZIPPED-"
    comment = b"" if kind == 8 else f"{claim}{zlib.crc32(raw[at : at + size]):08X}".encode()
    return raw[:-2] + struct.pack("<H", len(comment)) + comment


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as an archive of its text and of its bytes backwards."""

    def run(batches):
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            numbers, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            made = [_zip(n, t or b"") for n, t in zip(numbers, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in numbers]), pa.array(made, pa.binary())], ["path", "content"])

    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.col("text").cast("binary"))
    return docs.mapInArrow(run, "path string, content binary")
