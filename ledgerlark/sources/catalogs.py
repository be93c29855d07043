"""Catalog sources and sinks. Readers take binaryFile rows, one file a task's unit; each yields the same item rows."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROM = ["name", "size", "crc", "sha1", "md5", "sha256", "merge", "status", "region", "mia", "date"]
_SET = ["cloneof", "romof", "sampleof", "description", "manufacturer", "year", "board", "sourcefile", "id", "cloneof_id", "is_bios", "is_device", "runnable"]
_NAMED = {"cloneofid": "cloneof_id", "isbios": "is_bios", "isdevice": "is_device"}
FIELDS = ["set_name", *_ROM, *_SET, "category", "device_ref", "more", "is_disk"]
SCHEMA = "path string, format string, ord long, set_name string, " + ", ".join(f"{c} string" for c in (*_ROM, *_SET)) + ", category array<string>, device_ref array<string>, more map<string,string>, is_disk boolean"


def sniff(text: str) -> str:
    """The format by the first line that isn't blank."""
    line = next((x.lower() for x in text.lstrip("﻿").splitlines() if x.strip()), "")
    if "xml" in line:
        return "xml"
    if any(w in line for w in ("clrmamepro", "clrmame", "game", "machine", "raine")):
        return "cmpro"
    if "doscenter" in line:
        return "doscenter"
    if "[credits]" in line:
        return "romcenter"
    return "cmpro" if re.match(r"\s*\w+\s*\(", line) else "unknown"  # a block of another program's name


def _item(set_name: str | None, own: dict, shared: dict, disk: bool = False) -> dict:
    """One item; `more` holds what a set says in a block of its own (publisher, genre and the like)."""
    given = {_NAMED.get(k, k): v for k, v in shared.items()}
    row = {k: own.get(k) for k in _ROM} | {k: given.get(k) for k in _SET}
    return {"set_name": set_name, **row, **{k: given.get(k) or None for k in ("category", "device_ref", "more")}, "is_disk": disk}


_TEXTS = ("description", "manufacturer", "year", "board")
_BLOCKS = ("emuarc", "trurip", "tosec")


def _texts_of(node: ET.Element) -> dict:
    """What a set's element says beside its items."""
    out: dict = {k: v.text for k in _TEXTS if (v := node.find(k)) is not None}
    out["category"] = [x.text for x in node.findall("category") if x.text]
    out["device_ref"] = [x.get("name") for x in node.findall("device_ref") if x.get("name")]
    out["more"] = {x.tag: x.text for tag in _BLOCKS for block in node.findall(tag) for x in block if x.text}
    return out


def parse_xml(text: str) -> Iterator[dict]:
    """Catalogs with games or machines, in directories or not, and software lists."""
    root = ET.fromstring(text)

    def walk(node: ET.Element, folder: str) -> Iterator[dict]:
        for child in node:
            if child.tag == "dir":
                yield from walk(child, folder + child.get("name", "") + "/")
            elif child.tag in ("game", "machine", "software"):
                shared = {**child.attrib, **_texts_of(child)}
                name = folder + child.get("name", "")
                last = None
                for part in child.iter():
                    if part.tag == "rom" and part.get("name") is None and part.get("loadflag") in ("continue", "ignore"):
                        if last is not None and part.get("size"):
                            last["size"] = str(int(last["size"] or "0", 0) + int(part.get("size"), 0))
                    elif part.tag in ("rom", "disk"):
                        if last is not None:
                            yield last
                        last = _item(name, part.attrib, shared, part.tag == "disk")
                if last is not None:
                    yield last

    yield from walk(root, "")


_TOKEN = re.compile(r'"([^"]*)"|([()])|([^\s()"]+)')


def _tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted); lines that start with //, # or ; are comments."""
    for line in text.splitlines():
        if not line.lstrip().startswith(("//", "#", ";")):
            for m in _TOKEN.finditer(line):
                yield (m[1], True) if m[1] is not None else (m[2] or m[3], False)


def _block(tokens: Iterator[tuple[str, bool]]) -> list[tuple[str, object]]:
    """Pairs of key and value (or nested block) up to the closing bracket."""
    out, key = [], None
    for token, quoted in tokens:
        if token == ")" and not quoted:
            break
        if token == "(" and not quoted:
            out.append((key or "", _block(tokens)))
            key = None
        elif key is None:
            if token.lower() in ("nodump", "baddump") and not quoted:
                out.append(("status", token.lower()))
            else:
                key = token.lower()
        else:
            out.append((key, token))
            key = None
    return out


def parse_cmpro(text: str) -> Iterator[dict]:
    def walk(block: list[tuple[str, object]], folder: str) -> Iterator[dict]:
        for key, value in block:
            if isinstance(value, list):
                shared = {k: v for k, v in value if isinstance(v, str)}
                shared |= {"category": [v for k, v in value if k == "category" and isinstance(v, str)], "device_ref": [v for k, v in value if k == "device_ref" and isinstance(v, str)]}
                if key == "dir":
                    yield from walk(value, folder + shared.get("name", "") + "/")
                elif key in ("game", "machine", "resource"):
                    for kind, own in value:
                        if kind in ("rom", "disk") and isinstance(own, list):
                            fields = dict(own)
                            fields["status"] = fields.get("status") or fields.get("flags")
                            yield _item(folder + shared.get("name", ""), fields, shared, kind == "disk")

    yield from walk(_block(_tokens(text)), "")


_DOS_FILE = re.compile(r"^\s*file\s*\(\s*name\s+(.*)\s+size\s+(\S+)(.*)\)\s*$", re.IGNORECASE)


def parse_doscenter(text: str) -> Iterator[dict]:
    name = None
    for line in text.splitlines():
        if m := _DOS_FILE.match(line):
            rest = dict(re.findall(r"(?i)\b(date|crc|md5|sha1|sha256)\s+(\S+(?:\s+\d+:\d+(?::\d+)?)?)", m[3]))
            yield _item(name, {"name": m[1], "size": m[2], **{k.lower(): v for k, v in rest.items()}}, {})
        elif m := re.match(r'^\s*name\s+"?(.*?)"?\s*$', line, re.IGNORECASE):
            name = re.sub(r"(?i)\.zip$", "", m[1])


def parse_romcenter(text: str) -> Iterator[dict]:
    section = ""
    for line in text.splitlines():
        if line.strip().startswith("["):
            section = line.strip().lower()
        elif section in ("[games]", "[resources]") and "¬" in line:
            f = (line.strip().strip("¬").split("¬") + [""] * 9)[:9]
            shared = {"cloneof": f[0] or None, "romof": f[7] or None, "description": f[3]}
            yield _item(f[2], {"name": f[4], "crc": f[5], "size": f[6], "merge": f[8] or None}, shared)


_HEADER = ["name", "description", "category", "version", "date", "author", "email", "homepage", "url", "comment", "header", "merge_type", "packing"]
HEADER_SCHEMA = "path string, format string, " + ", ".join(f"{c} string" for c in _HEADER) + ", mame boolean"
_NAMES = {"forcemerging": "merge_type", "forcepacking": "packing", "forcezipping": "packing"}


def _header(fields: dict[str, str | None], mame: bool = False) -> dict:
    given = {_NAMES.get(k.lower(), k.lower()): v for k, v in fields.items() if v is not None and v.strip()}
    return {c: given.get(c) for c in _HEADER} | {"mame": mame}


def parse_header(text: str, kind: str) -> dict:
    """The catalog's own fields, whatever its format; those that it lacks are None."""
    if kind == "xml":
        root = ET.fromstring(text)
        if root.tag.lower() in ("mame", "m1", "mess"):
            return _header({"name": root.get("build"), "description": root.get("build")}, mame=True)
        if root.tag.lower() == "softwarelist":
            return _header(dict(root.attrib))
        head = root.find("header")
        fields = {x.tag: x.text for x in head} if head is not None else {}
        for x in head if head is not None else ():
            fields |= {k: v for k, v in x.attrib.items() if k in ("header", "forcemerging", "forcepacking")}  # of settings for managers
        return _header(fields)
    if kind == "cmpro":
        first = next((v for k, v in _block(_tokens(text)) if isinstance(v, list) and k not in ("game", "machine", "resource", "dir")), [])
        return _header({k: v for k, v in first if isinstance(v, str)})
    if kind == "doscenter":
        head = re.search(r"(?is)doscenter\s*\((.*?)\n\s*\)", text)
        lines = re.findall(r"(?m)^\s*([A-Za-z]+):?[ \t]+(.*?)\s*$", head[1]) if head else []
        return _header({k: v.strip('"') for k, v in lines})
    if kind == "romcenter":
        pairs, section = {}, ""
        for line in text.splitlines():
            if line.strip().startswith("["):
                section = line.strip().lower()
            elif "=" in line and section in ("[credits]", "[dat]", "[emulator]"):
                key, value = (x.strip() for x in line.split("=", 1))
                if section == "[emulator]":
                    key = {"refname": "name", "version": "description"}.get(key.lower(), "")
                elif section == "[dat]":
                    flag = value == "1"
                    key, value = ("merge_type", key.lower()) if key.lower() in ("split", "merge") and flag else ("", "")
                    value = {"merge": "full"}.get(value, value)
                if key:
                    pairs.setdefault(key, value)
        return _header(pairs)
    return _header({})


PARSERS = {"xml": parse_xml, "cmpro": parse_cmpro, "doscenter": parse_doscenter, "romcenter": parse_romcenter}


def parse(content: bytes) -> tuple[str, list[dict]]:
    """(format, items); gzip is unpacked first. What can't be read is of format 'unknown' and has no items."""
    try:
        data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        text = data.decode("utf-8-sig", errors="replace")
        kind = sniff(text)
        return kind, list(PARSERS[kind](text)) if kind in PARSERS else []
    except (OSError, EOFError, ET.ParseError):
        return "unknown", []


def parse_catalogs(files: DataFrame) -> DataFrame:
    """files(path, content) to their items, whatever their formats."""
    kinds = {"category": pa.list_(pa.string()), "device_ref": pa.list_(pa.string()), "more": pa.map_(pa.string(), pa.string()), "is_disk": pa.bool_(), "ord": pa.int64()}
    arrow = pa.schema([(c, kinds.get(c, pa.string())) for c in ["path", "format", "ord", *FIELDS]])

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                kind, items = parse(content)
                for i, x in enumerate(items):
                    rows.append({"path": where, "format": kind, "ord": i, **x, "more": list((x["more"] or {}).items()) or None})
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Items of all .dat, .xml and .datz files below path, whatever their formats."""
    return parse_catalogs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{dat,xml,datz}").load(path))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a catalog file below path with what it says of itself; unreadable ones are of format 'unknown'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{dat,xml,datz}").load(path)

    def run(batches):
        for b in batches:
            rows = []
            for where, content in zip(b["path"], b["content"], strict=True):
                try:
                    text = (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8-sig", errors="replace")
                    kind = sniff(text)
                    rows.append({"path": where, "format": kind, **parse_header(text, kind)})
                except (OSError, EOFError, ET.ParseError):
                    rows.append({"path": where, "format": "unknown", **_header({})})
            yield pd.DataFrame(rows, columns=["path", "format", *_HEADER, "mame"])

    return files.select("path", "content").mapInPandas(run, HEADER_SCHEMA)


def read_large_xml(spark: SparkSession, path: str, row_tag: str = "game") -> DataFrame:
    """One large XML catalog, split over tasks by Spark's own reader with a fixed schema. Items without a place of their
    own in files are numbered within their set, disks after roms."""
    entry = "array<struct<" + ",".join(f"_{c}:string" for c in _ROM) + ">>"
    names = {"cloneof": "_cloneof", "romof": "_romof", "id": "_id", "cloneof_id": "_cloneofid", "is_bios": "_isbios", "is_device": "_isdevice", "runnable": "_runnable", "description": "description", "year": "year", "manufacturer": "manufacturer"}
    schema = "_name string, " + ", ".join(f"{c} string" for c in names.values()) + f", category array<string>, device_ref array<struct<_name:string>>, rom {entry}, disk {entry}"
    games = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    none = F.array().cast(entry)
    tagged = lambda c, disk: F.transform(F.coalesce(c, none), lambda r: F.struct(r.alias("r"), F.lit(disk).alias("is_disk")))
    each = games.withColumn("all", F.concat(tagged("rom", False), tagged("disk", True))).select("*", F.posexplode("all").alias("ord", "x"))
    refs = F.transform("device_ref", lambda d: d["_name"]).alias("device_ref")
    return each.select(F.col("_name").alias("set_name"), *(F.col(f"x.r._{c}").alias(c) for c in _ROM), *(F.col(v).alias(k) for k, v in names.items()), "category", refs, "ord", "x.is_disk")


def xml_lines(items: DataFrame, old_style: bool = True) -> DataFrame:
    """(set_name, value): one element a set (game, or in the new style set and file), for write.text between a header and
    a closing tag. Disks are disks; blank attributes and status good are left out. Sets are made from their own rows alone."""
    element, file_tag = ("game", "rom") if old_style else ("set", "file")

    def run(batches):
        for b in batches:
            rows = []
            for name, roms in zip(b["set_name"], b["roms"], strict=True):
                parts = [f"\t<{element} name={quoteattr(name or '')}>"]
                for r in roms:
                    given = {k: r[k] for k in ("name", "size", "crc", "sha1", "md5", "status") if r[k] is not None and str(r[k]) and not (k == "status" and r[k] == "good")}
                    tag = "disk" if r["is_disk"] else file_tag
                    parts.append(f"\t\t<{tag} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in given.items()) + "/>")
                rows.append((name, "\n".join([*parts, f"\t</{element}>"])))
            yield pd.DataFrame(rows, columns=["set_name", "value"])

    disk = F.coalesce("is_disk", F.lit(False)) if "is_disk" in items.columns else F.lit(False)
    fields = F.struct("ord", "name", "size", "crc", "sha1", "md5", "status", disk.alias("is_disk"))
    return items.groupBy("set_name").agg(F.array_sort(F.collect_list(fields)).alias("roms")).mapInPandas(run, "set_name string, value string")


def _attribute(name: str, value: Column) -> Column:
    text = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f' {name}="'), text, F.lit('"'))).otherwise("")


def mame_lines(items: DataFrame) -> DataFrame:
    """(set_name, value): one machine element a set, merge names included, for write.text between a header and a closing
    tag."""
    fields = F.concat(*(_attribute(c, F.col(c)) for c in ("name", "merge", "size", "crc", "md5", "sha1")), _attribute("status", F.nullif(F.lower("status"), F.lit("good"))))
    line = F.concat(F.when(F.col("is_disk"), "\t\t<disk").otherwise("\t\t<rom"), fields, F.lit("/>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("\t<machine"), _attribute("name", F.first("set_name")), _attribute("cloneof", F.first("cloneof", True)), _attribute("romof", F.first("romof", True)), F.lit(">"))
    about = F.coalesce(F.concat(F.lit("\t\t<description>"), F.replace(F.replace(F.first("description", True), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</description>\n")), F.lit(""))
    return items.groupBy("set_name").agg(F.concat(head, F.lit("\n"), about, F.array_join(lines, "\n"), F.lit("\n\t</machine>")).alias("value"))


def json_lines(items: DataFrame) -> DataFrame:
    """(set_name, value): one JSON object a set with its items in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "name", "size", "crc", "sha1", "md5", "status")))
    return items.groupBy("set_name").agg(F.to_json(F.struct(F.first("set_name").alias("name"), listed.alias("items"))).alias("value"))


def doscenter_lines(items: DataFrame) -> DataFrame:
    """(set_name, value): one game block a set."""
    line = F.concat(F.lit("\tfile ( name "), "name", F.lit(" size "), F.coalesce(F.col("size").cast("string"), F.lit("0")), F.lit(" crc "), F.coalesce("crc", F.lit("")), F.lit(" )"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return items.groupBy("set_name").agg(F.concat(F.lit('game (\n\tname "'), F.first("set_name"), F.lit('.zip"\n'), F.array_join(lines, "\n"), F.lit("\n)")).alias("value"))


def text_report(df: DataFrame) -> DataFrame:
    """Rows as fixed-width text, columns as wide as their longest value."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    widths = text.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in df.columns)).first()
    cells = [F.rpad(c, int(widths[c] or len(c)), " ") for c in df.columns]
    return text.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
