"""Removal of passages that documents repeat, by prefix-partitioned suffix trees over words.

A window is `window` consecutive words of one document; words are runs without ASCII white space, unchanged. Every word
goes that is covered by a window whose word sequence also starts in a document with a smaller doc_id. Windows are judged
on the input.

1. Prefixes. Each word has a symbol of 8 bits (from its first, last and second byte and its length). A first pass over
   all documents counts the suffixes (of at least `window` words) under each pair of leading symbols, and takes a sample of
   suffixes, whole windows of symbols, by a fixed stride (SAMPLES_A_GROUP strings for each group to be, which go to the
   driver); the sample sets where groups begin and nothing else.
2. Groups. Suffixes are ordered by their symbols. Cells of two symbols share a group until it holds `group_windows`
   suffixes; a cell with more is cut by prefixes of any length, the shortest that tell neighbouring quantiles of its sample
   apart. So a group's size does not depend on how common its first words are; only equal windows can't be parted, and they
   are one suffix a block.
3. Suffixes go to their group in packed form: the 64-bit label of the path to depth `window` and the place. A path label
   is built by doubling (labels of 1, 2, 4, ... words, each mixed from two of half the length). Before that, each block of
   documents settles its own repeats: an occurrence that follows a smaller doc_id in the same block is settled there, and of
   the least document's occurrences of a window the first travels, the others follow its fate. A passage in a third of
   all rows thus costs a row a block.
4. Subtrees. In a group, suffixes sorted by label are the leaves of its subtree in order; equal labels are the internal
   nodes at depth `window`. At such a node all leaves but those of the least document are repeats. Runs of them along a
   document are the maximal repeats; they go back to their block and become cover per document.

Labels are only compared within a group, and groups differ in words; so n windows have n * group_windows / 2^65 pairs, in
expectation, that are taken for equal and are not.

Edge cases: null text: no words. A row with a null doc_id takes no part: nothing is removed from it, nor on its account.
Rows that share a doc_id never remove each other's words and are told apart by a hash of their text. Empty tables give
empty results. Texts of any length are processed whole (a document is never split; memory follows the longest one).
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes, discard, lean, materialise, release_shuffles

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CELLS, SAMPLES_A_GROUP = 1 << 16, 32


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end (in bytes)."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def symbols(text: bytes) -> np.ndarray:
    """The 8-bit symbol of each word."""
    start, end = word_spans(text)
    if not len(start):
        return np.empty(0, np.uint8)
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    mixed = data[start] * 31 + data[end - 1] * 17 + data[np.minimum(start + 1, end - 1)] * 101 + (end - start).astype(np.uint32) * 7
    return (mixed ^ (mixed >> 8)).astype(np.uint8)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left ^ (left >> np.uint64(29))) * _A + right * _B
    x ^= x >> np.uint64(32)
    x *= _A
    return x ^ (x >> np.uint64(30))


def path_labels(words: np.ndarray, window: int) -> np.ndarray:
    """Labels of the paths of `window` words that start at each place; words: 64-bit hashes."""
    out, level, length, at, left = None, words, 1, 0, window
    while left:
        if left & 1:
            part = level[at : at + len(words) - window + 1]
            out = part if out is None else _mix(out, part)
            at += length
        left >>= 1
        if left:
            level, length = _mix(level[: len(level) - length], level[length:]), 2 * length
    return out


def _planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed byte planes of their steps."""
    steps = np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(x: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


_NAMES = ["part", "block", "kind", "ids", "labels", "places"]
_SCHEMA = "part int, block long, kind int, ids binary, labels binary, places binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_SUFFIXES, _TABLE, _SETTLED, _COPIES = 0, 1, 2, 3


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _windows_by_prefix(docs: DataFrame, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least `window` words under each pair of leading symbols, over all documents (65,536 counts), and a
    sorted sample of them as strings of `window` symbols: every stride-th of a task."""

    def run(batches):
        counts, taken, seen = np.zeros(_CELLS, np.int64), [], 0
        for b in batches:
            for x in as_bytes(b.column(0)):
                if x and len(x) >= 2 * window - 1:
                    s = symbols(x)
                    n = len(s) - window + 1
                    if n > 0:
                        second = s[1 : n + 1] if window > 1 else np.zeros(n, np.uint8)
                        counts += np.bincount((s[:n].astype(np.int32) << 8) + second, minlength=_CELLS)
                        taken += [s[i : i + window].tobytes() for i in range(-seen % stride, n, stride)]
                        seen += n
        full = np.flatnonzero(counts)
        columns = [pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(counts[full], 0)), pa.array([None] * len(full) + [b"".join(taken)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "sample"])

    found = materialise(docs.select("text").mapInArrow(lean(run), "cell int, n long, sample binary"))
    cells = found.where("cell >= 0").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_CELLS, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    sample = b"".join(r["sample"] for r in found.where("cell < 0").select("sample").toLocalIterator())
    discard(found)
    return out, np.sort(np.frombuffer(sample, f"V{window}").view(f"S{window}")) if sample else np.empty(0, f"S{window}")


class Groups:
    """Where suffixes go: `first` has each cell's group; suffixes of cells in `cut` go on by how many of the sorted prefixes
    in `bounds` are not above their symbols. `total` is the number of groups."""

    def __init__(self, counts: np.ndarray, sample: np.ndarray, window: int, group_windows: int):
        self.first, self.cut, bounds = np.zeros(len(counts), np.int32), np.zeros(len(counts), bool), []
        group, held = 0, 0
        for cell in np.flatnonzero(counts):
            n = int(counts[cell])
            own = []
            if n > group_windows:
                low, high = (np.searchsorted(sample, np.array([bytes([c >> 8, c & 255])[: min(window, 2)]], sample.dtype))[0] if c < len(counts) else len(sample) for c in (cell, cell + (1 if window > 1 else 256)))
                own = _prefixes_at(sample[low:high], -(-n // group_windows))
            if held and (own or held + n > group_windows):
                group, held = group + 1, 0
            self.first[cell] = group
            if own:
                self.cut[cell] = True
                bounds += own
                group += len(own) + 1
            else:
                held += n
        self.total = group + (held > 0)
        self.bounds = np.array(sorted(bounds), sample.dtype) if bounds else np.empty(0, sample.dtype)

    def of(self, cell: np.ndarray, windows_at) -> np.ndarray:
        """Groups of suffixes; windows_at(rows) gives the symbols of some of them."""
        out = self.first[cell]
        rows = np.flatnonzero(self.cut[cell])
        for i in range(0, len(rows), 1 << 16):
            part = rows[i : i + (1 << 16)]
            start = np.searchsorted(self.bounds, np.stack([cell[part] >> 8, cell[part] & 255], axis=1).astype(np.uint8).copy().view("S2").ravel().astype(self.bounds.dtype))
            out[part] += (np.searchsorted(self.bounds, windows_at(part), "right") - start).astype(np.int32)
        return out


def _prefixes_at(sample: np.ndarray, parts: int) -> list[bytes]:
    """Prefixes that cut a sorted sample into that many parts of about one size, each the shortest that tells its quantile
    from the string before; fewer, where strings repeat."""
    out = []
    for at in np.unique(np.arange(1, parts) * len(sample) // parts):
        if 0 < at < len(sample) and sample[at] != sample[at - 1]:
            a, b = bytes(sample[at - 1]), bytes(sample[at])
            n = next((i for i in range(len(b)) if i >= len(a) or a[i] != b[i]), len(b))
            out.append(b[: n + 1])
    return out


def _block_rows(block: int, ids: list[int], tags: list[int], texts: list[bytes], window: int, groups: Groups, parts: int):
    """The rows that one block of documents sends on."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    id_of, tag_of = np.array(ids, np.int64)[order], np.array(tags, np.int64)[order]
    hashed = [np.fromiter(map(xxhash.xxh64_intdigest, texts[i].split()), np.uint64) for i in order]
    lengths = np.fromiter(map(len, hashed), np.int64, len(hashed))
    words = np.concatenate(hashed)
    del hashed
    sym = np.concatenate([symbols(texts[i]) for i in order])
    texts.clear()
    ends = np.cumsum(lengths)
    starts = ends - lengths
    usable = np.maximum(lengths - window + 1, 0)
    if not usable.any():
        return []
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), usable)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(usable) - usable, usable) + starts[doc]
    label = path_labels(words, window)[place]
    del words
    by_label = np.argsort(label, kind="stable")  # places ascend with doc_id, so each node's first leaf has the least
    sorted_labels, leaf_id = label[by_label], id_of[doc[by_label]]
    gone, follows = np.zeros(len(label), bool), np.zeros(len(label), bool)
    beyond = _beyond_least(sorted_labels, leaf_id)
    gone[by_label[beyond]] = True
    new = np.ones(len(label), bool)
    new[1:] = sorted_labels[1:] != sorted_labels[:-1]
    again = np.flatnonzero(~new & ~beyond)  # further occurrences in a least document
    leader = by_label[np.maximum.accumulate(np.where(new, np.arange(len(label)), 0))[again]]
    again = by_label[again]
    follows[again] = True
    del by_label, sorted_labels, leaf_id, beyond, new
    out = [(block % parts, block, _TABLE, np.stack([id_of, tag_of, starts]).astype("<i8").tobytes(), b"", b"")]
    if gone.any():
        out.append((block % parts, block, _SETTLED, b"", b"", _planes(place[gone])))
    if len(again):
        pairs = np.stack([place[leader], place[again]])
        out.append((block % parts, block, _COPIES, b"", zstandard.ZstdCompressor(level=1).compress(pairs[:, np.argsort(pairs[1])].astype("<u4").tobytes()), b""))
    travels = ~(gone | follows)
    place, label, doc = place[travels], label[travels], doc[travels]
    at = lambda k: sym[np.minimum(place + k, len(sym) - 1)].astype(np.int32)
    cell = (at(0) << 8) + (at(1) if window > 1 else 0)
    every = np.lib.stride_tricks.sliding_window_view(sym, window) if len(sym) >= window else sym.reshape(1, -1)
    group = groups.of(cell, lambda rows: np.ascontiguousarray(every[place[rows]]).view(f"S{window}").ravel())
    del cell, sym, every
    by_group = np.argsort(group, kind="stable")
    group, place, label, doc = group[by_group], place[by_group], label[by_group], doc[by_group]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], [len(group)][: len(cuts)]), strict=True):
        seen, runs = np.unique(doc[a:b], return_counts=True)  # documents of ascending places
        table = np.stack([id_of[seen], runs]).astype("<i8").tobytes()
        out.append((int(group[a]), block, _SUFFIXES, zstandard.ZstdCompressor(level=1).compress(table), label[a:b].astype("<u8").tobytes(), _planes(place[a:b])))
    return out


def _beyond_least(labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For leaves in order of (label, doc_id): which have a greater doc_id than the first of their node."""
    if not len(labels):
        return np.zeros(0, bool)
    new = np.ones(len(labels), bool)
    new[1:] = labels[1:] != labels[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(labels)), 0))
    return ids > ids[first]


def _send(docs: DataFrame, window: int, groups: Groups, parts: int, block_bytes: int) -> DataFrame:
    def run(batches):
        block, ids, tags, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0

        def flush():
            nonlocal block, ids, tags, texts, size
            if ids:
                rows = _block_rows(block, ids, tags, texts, window, groups, parts)
                for i in range(0, len(rows), 16):
                    yield _rows(rows[i : i + 16])
                del rows
            block, ids, tags, texts, size = block + 1, [], [], [], 0

        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            for i, tag, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                if i is not None and x and len(x) >= 2 * window - 1:
                    ids.append(i)
                    tags.append(tag)
                    texts.append(x)
                    size += len(x)
                    if size >= block_bytes:
                        yield from flush()
        yield from flush()

    return docs.select("doc_id", "tag", "text").mapInArrow(lean(run), _SCHEMA)


def _subtree(rows: list[tuple]) -> list[tuple]:
    """One group's suffixes: the places that are repeats, a row a block."""
    ids, sizes = [], []
    for _, table, labels, _ in rows:
        doc, runs = np.frombuffer(zstandard.ZstdDecompressor().decompress(table), "<i8").reshape(2, -1)
        ids.append(np.repeat(doc, runs))
        sizes.append(len(labels) // 8)
    label, doc = np.frombuffer(b"".join(r[2] for r in rows), "<u8"), np.concatenate(ids)
    by_label = np.argsort(label, kind="stable")
    same = label[by_label]
    shared = np.zeros(len(same), bool)
    shared[1:] = same[1:] == same[:-1]
    shared[:-1] |= shared[1:]  # leaves of internal nodes; the rest are leaves of their own
    leaves = by_label[shared]
    leaves = leaves[np.lexsort((doc[leaves], label[leaves]))]
    gone = np.zeros(len(label), bool)
    gone[leaves[_beyond_least(label[leaves], doc[leaves])]] = True
    out, at = [], 0
    for (block, _, _, places), n in zip(rows, sizes, strict=True):
        mine = gone[at : at + n]
        at += n
        if mine.any():
            out.append((0, block, _SETTLED, b"", b"", _planes(_from_planes(places)[mine])))
    return out


def _grow(sent: DataFrame) -> DataFrame:
    """sent: sorted by group within partitions, each group in one. Replaces suffix rows by the repeats among them."""

    def run(batches):
        part, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[2] != _SUFFIXES:
                    yield _rows([row])
                    continue
                if row[0] != part and held:
                    if found := _subtree(held):
                        yield _rows(found)
                    held = []
                part = row[0]
                held.append((row[1], *row[3:]))
        if held and (found := _subtree(held)):
            yield _rows(found)

    return sent.mapInArrow(lean(run), _SCHEMA)


def _cover(grown: DataFrame, window: int) -> DataFrame:
    """grown: sorted by block within partitions. (doc_id, tag, cover): runs of words to remove, as (start, end) pairs."""
    names = ["doc_id", "tag", "cover"]

    def documents(table: bytes, places: list[bytes], copies: list[bytes]):
        if not places:
            return
        id_of, tag_of, starts = np.frombuffer(table, "<i8").reshape(3, -1)
        place = np.unique(np.concatenate([_from_planes(p) for p in places]))
        for x in copies:
            leader, again = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4").reshape(2, -1).astype(np.int64)
            place = np.union1d(place, again[np.isin(leader, place)])
        doc = np.searchsorted(starts, place, "right") - 1
        place = place - starts[doc]
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + window)
        begin = np.flatnonzero(new)
        runs = np.stack([place[begin], place[np.append(begin[1:], len(place)) - 1] + window], axis=1).astype("<i8")
        owner = doc[begin]
        for d in np.unique(owner):
            yield int(id_of[d]), int(tag_of[d]), runs[owner == d].tobytes() if len(owner) < 64 else runs[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")].tobytes()

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], names)

    def run(batches):
        block, table, places, copies = None, b"", [], []
        for b in batches:
            for _, of, kind, ids, labels, where in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != block:
                    if rows := list(documents(table, places, copies)):
                        yield batch(rows)
                    block, table, places, copies = of, b"", [], []
                if kind == _TABLE:
                    table = ids
                elif kind == _COPIES:
                    copies.append(labels)
                else:
                    places.append(where)
        if rows := list(documents(table, places, copies)):
            yield batch(rows)

    return grown.mapInArrow(lean(run), "doc_id long, tag long, cover binary")


def kept_text(text: bytes, cover: bytes | None) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by one space)."""
    words = text.split()
    if not cover:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for a, b in np.frombuffer(cover, "<i8").reshape(-1, 2).tolist():
        kept += words[at:a]
        at = max(at, b)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def repeated_cover(docs: DataFrame, window: int = 50, group_windows: int = 1_000_000, block_bytes: int = 8_000_000) -> DataFrame:
    """docs: doc_id long, tag long (tells rows with one doc_id apart), text. Returns (doc_id, tag, cover) for each
    document that loses words, as a table in the shared folder."""
    counts, sample = _windows_by_prefix(docs, window, max(1, group_windows // SAMPLES_A_GROUP))
    groups = Groups(counts, sample, window, group_windows)
    parts = max(1, groups.total)
    sent = _send(docs, window, groups, parts, block_bytes).repartition(parts, "part").sortWithinPartitions("part")
    grown = _grow(sent).repartition(parts, "block").sortWithinPartitions("block")
    out = materialise(_cover(grown, window).dropDuplicates(["doc_id", "tag"]))  # repeated rows lose the same words
    del sent, grown
    release_shuffles(docs.sparkSession)
    return out


def without_repeats(docs: DataFrame, window: int = 50, **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: kept holds the words left, joined by one space."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    # the same plan at every size: texts are dealt out once, and Spark can split a sort-merge join's partitions
    joined = own.join(repeated_cover(own, window, **sizes).hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "cover")
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [kept_text(x or b"", c) for x, c in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True)]
                n, gone, kept = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return joined.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept string")


def cut_repeats(docs: DataFrame, window: int = 50, **sizes) -> DataFrame:
    """docs with all its columns, repeated passages cut out of text (what stays keeps its white space) and n_chars, if
    there, set anew. Documents that lose every word go."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    names = docs.columns
    of_id, of_tag, words = (n + "_" * max(map(len, names)) for n in ("id", "tag", "cover"))  # longer than any name there
    cover = repeated_cover(own, window, **sizes).toDF(of_id, of_tag, words).hint("merge")
    joined = docs.join(cover, (docs["doc_id"].cast("long") == F.col(of_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(of_tag)), "left").drop(of_id, of_tag)
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            columns, covers = list(b.columns[:-1]), b.column(len(names)).to_pylist()
            if any(c is not None for c in covers):
                texts = [x if c is None else _cut(x, c) for x, c in zip(as_bytes(b.column(place)), covers, strict=True)]
                kept = pa.array([c is None or bool(x) for x, c in zip(texts, covers, strict=True)], pa.bool_())
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string()).cast(columns[place].type)
                if chars is not None:
                    old = columns[chars].to_pylist()
                    columns[chars] = pa.array([n if c is None else len(x.decode()) for n, x, c in zip(old, texts, covers, strict=True)], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(kept)
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(lean(run), docs.schema)


def _cut(text: bytes, cover: bytes) -> bytes:
    start, _ = word_spans(text)
    start = [*start.tolist(), len(text)]
    kept, at = [], 0
    for a, b in np.frombuffer(cover, "<i8").reshape(-1, 2).tolist():
        kept.append(text[at : start[a]])
        at = start[b]
    kept.append(text[at:])
    out = b"".join(kept)
    return out if out.split() else b""
