"""Scalar expressions: field cleaning, null-tolerant equality, times, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def agrees(a: Column, b: Column) -> Column:
    """Null-tolerant equality: an unknown value contradicts nothing."""
    return F.coalesce(a == b, F.lit(True))


def same(a: Column, b: Column) -> Column:
    """Strict equality: an unknown value equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def tested(a: Column, b: Column) -> Column:
    """Both known and equal: counts as evidence."""
    return a.isNotNull() & b.isNotNull() & (a == b)


def clean_hash(raw: Column, digits: int) -> Column:
    """Hash text in catalogs: trimmed, lower case, without 0x; '-' and blanks are unknown, short ones are filled with
    zeros on the left, anything but hex digits is unknown, longer ones stay (an odd last digit goes)."""
    text = F.regexp_replace(F.lower(F.trim(raw)), "^0x", "")
    filled = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    whole = F.substring(filled, F.lit(1), (F.floor(F.length(filled) / 2) * 2).cast("int"))
    return F.when(text.rlike("^[0-9a-f]+$"), whole)


def parse_size(raw: Column) -> Column:
    """Sizes in catalogs: decimal or 0x hex; blank, '-' and anything else is unknown."""
    text = F.lower(F.trim(raw))
    hexed = F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)").cast("long")
    return F.when(text.rlike("^0x[0-9a-f]{1,15}$"), hexed).when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long"))


def yes_no(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)).isin("yes", "true"), F.lit(False))


def strip_chd(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.chd$", "")


def clean_file_name(name: Column) -> Column:
    """Backslashes become slashes, './' a slash, and characters that file systems refuse a dash."""
    slashed = F.replace(F.replace(name, F.lit("\\"), F.lit("/")), F.lit("./"), F.lit("/"))
    return F.regexp_replace(slashed, r'[:*?<>|"\x00-\x1f]', "-")


def stem(name: Column) -> Column:
    """File name without directories and last extension."""
    last = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def dos_time(packed: Column) -> Column:
    """32-bit DOS date and time as a timestamp; what isn't one is null."""
    part = lambda shift, bits: F.shiftright(packed, shift).bitwiseAND(F.lit((1 << bits) - 1))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(25, 7) + 1980, part(21, 4), part(16, 5), part(11, 5), part(5, 6), part(0, 5) * 2)
    return F.when(packed.between(1, 0xFFFFFFFF), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def split_list(raw: Column) -> Column:
    """Text with bars to a list of trimmed entries."""
    return F.transform(F.split(raw, r"\|"), lambda x: F.trim(x))


def dat_path(path: Column, root: str, dat_root: str) -> Column:
    """A path below the collection root, as one below the catalog root."""
    return F.regexp_replace(path, f"^{root}", dat_root)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def ignore_regex(patterns: list[str]) -> str:
    """One Java regular expression for ignore patterns: wildcards, anchored, or raw after 'regex:'; 'ignore:' marks
    patterns for scans and is dropped here."""
    out = []
    for p in patterns:
        p = p.removeprefix("ignore:")
        if p.startswith("regex:"):
            out.append(p[6:])
        else:
            out.append("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c not in " _/" else c for c in p) + "$")
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in out) + ")" if out else "(?!)"


def unix_time(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp without zone."""
    return F.timestamp_micros(seconds * 1_000_000).cast("timestamp_ntz")


def ntfs_time(ticks: Column) -> Column:
    """Steps of 100 ns since 1601 as a timestamp without zone."""
    return F.timestamp_micros(F.floor(ticks / F.lit(10).cast("decimal(2,0)")).cast("long") - 11_644_473_600_000_000).cast("timestamp_ntz")


def doscenter_time(raw: Column) -> Column:
    """Dates in DOSCenter catalogs: yyyy/MM/dd HH:mm:ss, or with dashes; anything else is unknown."""
    return F.try_to_timestamp(F.replace(F.trim(raw), F.lit("-"), F.lit("/")), F.lit("yyyy/M/d H:m:s")).cast("timestamp_ntz")


def join_list(entries: Column) -> Column:
    """A list to text with bars; blank entries go."""
    return F.array_join(F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: x != ""), "|")


def null_first(value: Column) -> Column:
    """Sort key by which what is unknown comes before everything."""
    return value.asc_nulls_first()


# The upper half of code page 437, made from the standard codec: character -> byte.
_CP437 = bytes(range(128, 256)).decode("cp437")


def is_cp437(name: Column) -> Column:
    """Can a zip entry's name be stored without the UTF-8 flag? ASCII but control characters, or the code page's upper half."""
    return ~name.rlike("[^ -~" + "".join(f"\\x{{{ord(c):04x}}}" for c in _CP437) + "]")


def cp437_bytes(name: Column) -> Column:
    """The name's bytes in code page 437; null where it has a character that the page lacks."""
    code = F.create_map(*(F.lit(x) for i, c in enumerate(_CP437, 128) for x in (c, f"{i:02x}")))
    each = F.transform(F.split(name, ""), lambda c: F.when(c.rlike("^[ -~]$"), F.lower(F.hex(c))).otherwise(F.try_element_at(code, c)))
    return F.when(is_cp437(name), F.when(name == "", F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(each, ""))))
