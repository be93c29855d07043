"""Packing documents into token sequences by bulk-synchronous best fit.

A document is its token ids followed by an end id. Longer ones are cut into pieces of `size` tokens (the last may be
shorter); pieces are placed whole, the longest first, each into the sequence with the least gap that holds it (of equal
gaps the sequence opened first), so that few sequences are needed.

Pieces and gaps are range-sorted by length and kept as runs: a run of pieces is a length and how many there are, a run of
gaps is a gap and consecutive sequences that have it. A round takes all pieces of the next length at once. A successor
sweep goes up the gaps from that length; the pieces' ranks settle who goes where: a gap is refilled until it is shorter
than the pieces, then the next of its run is taken, so rank r goes to sequence r div q of the run, where q pieces fit one
gap. The gaps are updated and the next length follows; pieces without a gap open sequences. The result is the one of
sequential best fit, place by place (tests hold it against that). Runs are at most some `size` squared whatever the number
of documents, so the sweeps themselves are worked in one place; ranking and placing pieces is distributed. A plan is
shipped to tasks in slices of at most PLAN_ROWS rows.

Ranks are dealt without sorting everything in one place: tokenising tasks number pieces per length, one row per task
and length is summed up over tasks, and base plus own number is the rank.

Token ids come from the `tokenizers` library. With a file whose pre-tokenizer drops white space, distinct runs of
non-space characters are encoded once and the runs' ids are joined (tests hold this against encoding whole texts).

Null text: an empty document, one piece with only the end id. Rows with null or repeated doc_id are packed like others.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm._shared import KEPT, as_bytes, materialise

PLAN_ROWS = 4_000_000


#: What a file must have for its texts to be encoded run by run: white space only separates.
_RUN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs whose pre-tokens are plain to see: Latin letters that composition leaves alone, then marks that are one pre-token.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([-.,;:!?*#%&$()\"/+=_]*)")


class RunEncoder(dict):
    """ids of a text from the ids of its runs of non-space bytes. Known runs (up to `held`) are looked up: the dict has
    a run's place in `start`. A new run of letters and closing marks goes straight to the tokenizer's model, as its two
    pre-tokens; any other run goes through the whole tokenizer. Files of another kind have their texts encoded whole."""

    def __init__(self, path: str, held: int = 400_000, longest: int = 48):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.held, self.longest = Tokenizer.from_file(path), held, longest
        self.model = self.tokenizer.model
        parts = json.loads(Path(path).read_text())
        steps = [x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_run = steps == _RUN_NORMALIZER and split.get("pattern", {}).get("Regex") == _RUN_PATTERN and split.get("invert") is True and split.get("behavior") == "Removed"
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(chr(c).lower())[0][0] for c in [*range(65, 91), *range(0xC0, 0x100)]}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.words: dict[str, tuple[int, ...]] = {}
        self.flat, self.start = array("I"), array("q", [0])

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = tuple(t.id for t in self.model.tokenize(word))
        return ids

    def __missing__(self, run: bytes) -> int:
        text = run.decode()
        if len(run) <= self.longest:
            at = self[run] = len(self.start) - 1
            if m := _PLAIN.fullmatch(text):
                self.flat.extend(self._word(m[1].translate(self.letters)))
                if m[2]:
                    self.flat.extend(self._word(m[2]))
                self.start.append(len(self.flat))
                return at
        self.flat.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.start.append(len(self.flat))
        return len(self.start) - 2

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_run:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        if len(self) > self.held or len(self.flat) > 16 * self.held:
            self.empty()
        places = [np.fromiter(map(self.__getitem__, t.split()), np.int64) for t in texts]
        start, flat, out = np.array(self.start), np.array(self.flat), []
        for at in places:
            n = start[at + 1] - start[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total) + np.repeat(start[at] - ends + n, n)])
        return out


@functools.lru_cache(2)
def run_encoder(path: str) -> RunEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return RunEncoder(path)


KEPT["packing"] = run_encoder.cache_clear


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts this task's pieces of that length from 0."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        encoder, task, seen = run_encoder(tokenizer), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, rows = b.slice(i, 512), []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([x or b"" for x in as_bytes(part.column(1))]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        own = ids[at : at + size]
                        rows.append((doc, k, at, len(own), zlib.crc32(own), task, seen[len(own)]))
                        seen[len(own)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def best_fit(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """counts: pieces of each length. Returns the plan's rows (length, first rank, number, per sequence, first sequence,
    offset) and the number of sequences. Piece first rank + i goes to sequence first sequence + i div q at offset +
    (i mod q) * length, where q is `per sequence`."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> heap of runs of sequences (first, number)
    known: list[int] = []  # gaps that have runs, ascending
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(known, gap)
            heapq.heappush(gaps[gap], (first, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(known, length)
            if at == len(known):  # no gap holds one: open as many sequences as the rest needs
                n = -(-left // (size // length))
                put(size, opened, n)
                opened += n
                continue
            gap = known[at]
            first, n = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                del gaps[gap], known[at]
            q = gap // length
            whole = min(n, left // q)
            rest = min(left - whole * q, q) if whole < n else 0  # what the next sequence of the run still takes
            for sequences, each, start in ((whole, q, first), (1, rest, first + whole)):
                if sequences and each:
                    plan.append((length, rank, sequences * each, each, start, size - gap))
                    put(gap - each * length, start, sequences)
                    rank, left = rank + sequences * each, left - sequences * each
            used = whole + (rest > 0)
            put(gap, first + used, n - used)
    return plan, opened


def _ranked(found: DataFrame) -> DataFrame:
    """found with rank: the place of each piece among all of its length."""
    by_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    found = materialise(pieces(docs, tokenizer, size, end))
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    plan, _ = best_fit(counts, size)
    ranked, parts, at = _ranked(found).select(*PIECE, "rank"), [], 0
    while at < len(plan):  # slices of whole lengths
        end_at = min(len(plan), at + PLAN_ROWS)
        while at < end_at < len(plan) and plan[end_at][0] == plan[end_at - 1][0]:
            end_at += 1
        own = ranked if end_at - at == len(plan) else ranked.where(F.col("length").between(plan[end_at - 1][0], plan[at][0]))
        parts.append(_place(own, plan[at:end_at]))
        at = end_at
    return functools.reduce(DataFrame.union, parts) if parts else _place(ranked, [])


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _place(ranked: DataFrame, plan: list[tuple]) -> DataFrame:
    by_length: dict[int, list] = {}
    for length, *row in plan:
        by_length.setdefault(length, []).append(row)
    sent = ranked.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in by_length.items()})

    def place(batches):
        rows = sent.value
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                of = length == n
                first, _, each, start, at = rows[int(n)]
                i = np.searchsorted(first, rank[of], "right") - 1
                beyond = rank[of] - first[i]
                sequence[of], offset[of] = start[i] + beyond // each[i], at[i] + beyond % each[i] * n
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in PIECE), pa.array(sequence), pa.array(offset)], [*PIECE, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
