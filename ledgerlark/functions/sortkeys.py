"""Collations as sort-key columns: order by them in turn."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(name: Column) -> list[Column]:
    return [name]


def torrent_zip(name: Column) -> list[Column]:
    """Only A-Z are folded."""
    return [F.translate(name, string.ascii_uppercase, string.ascii_lowercase), name]


def directory(name: Column) -> list[Column]:
    return [F.lower(name), name]


def seven_zip(name: Column) -> list[Column]:
    """Extension, stem, path, all case-sensitive."""
    path = F.regexp_extract(name, r"^(.*/)?[^/]*$", 1)
    last = F.regexp_extract(name, r"([^/]*)$", 1)
    ext = F.regexp_extract(last, r"\.([^.]*)$", 1)
    return [ext, F.regexp_replace(last, r"\.[^.]*$", ""), path]


def natural(name: Column) -> list[Column]:
    """Digit runs compare as numbers: each is led by the length of what stays without leading zeros."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        bare = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(F.lower(run))

    return [F.concat_ws("\x01", F.transform(runs, key)), name]


def by_type(name: Column, file_type: Column) -> list[Column]:
    """Members of zip and 7z archives and plain nodes each by their own order, in one list of keys."""
    zipped, packed, plain = torrent_zip(name), seven_zip(name), directory(name)
    first = F.when(file_type == "FileZip", zipped[0]).when(file_type == "FileSevenZip", packed[0]).otherwise(plain[0])
    second = F.when(file_type == "FileSevenZip", packed[1]).otherwise(name)
    third = F.when(file_type == "FileSevenZip", packed[2]).otherwise(F.lit(""))
    return [first, second, third, file_type]


def catalog(name: Column, time: Column, *flags: Column) -> list[Column]:
    """Catalogs of a directory: names whatever their case and accents' case, then time, then flags, false before true."""
    return [F.lower(name), name, time, *flags]


# Statuses in the order in which lists show them.
DISPLAY_ORDER = "Error UnSet UnScanned DirCorrupt MoveToCorrupt CorruptCanBeFixed CanBeFixedMIA CanBeFixed MoveToSort Delete NeededForFix Rename Corrupt Unknown UnNeeded Incomplete Missing MissingMIA CorrectMIA Correct InToSort NotCollected Ignore Deleted".split()


def display(status: Column) -> list[Column]:
    """Statuses as lists show them; those that lists don't show come last, by name."""
    place = F.try_element_at(F.create_map(*(x for i, s in enumerate(DISPLAY_ORDER) for x in (F.lit(s), F.lit(i)))), status)
    return [F.coalesce(place, F.lit(len(DISPLAY_ORDER))), status]


def grid(column: Column, name: Column, descending: bool = False) -> list[Column]:
    """A list sorted by one of its columns, either way; equal values by name."""
    return [column.desc_nulls_last() if descending else column.asc_nulls_first(), name.asc()]
