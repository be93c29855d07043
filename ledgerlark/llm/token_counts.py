"""Token counts under a unigram vocabulary by dynamic programming shared along a trie of pre-tokens.

Pre-tokens are the runs of a text whose pieces are independent: spaces (as metaspace markers) with the characters after
them, and line ends; so every character of a text counts, white space too. The distinct new pre-tokens of a batch are put
in order, which makes their trie: words with a common prefix are neighbours. It is walked level by level in numpy; the
best forward score of a node, and the number of tokens that reaches it, are computed once from its ancestors' for all
pre-tokens below it, and only the levels that the longest piece spans are held. Where no more than FEW words are that
deep, nothing is shared any more and the same recurrence goes on along each one. Terminal nodes store their count, and
documents sum up stored counts.

Scores: those of the model file if it is a unigram model; a BPE file only ranks its pieces, which then score
-(PIECE_COST + log(2 + rank)), where rank is the place among them by falling score: Zipf's law, and a price for each piece
that brings counts near those of the file's own merges (README has figures). A character that starts no piece costs 10
below the least score and as many tokens as it has UTF-8 bytes (with byte fallback; else one). Higher sums win, then
fewer tokens.

Null text: no tokens. Rows are independent, so nulls in other columns, repeats, ties and empty tables need no care.
Texts are counted whole, whatever characters they hold and however long their words are. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes
from ledgerlark.llm.pieces import MARK, NORMAL, UNIGRAM, USER, PieceModel, spaces

PIECE_COST, FEW = 4.0, 4


def unigram_scores(model: PieceModel) -> dict[str, float]:
    """Piece -> score."""
    own = sorted((p for p in model.pieces if p[2] in (NORMAL, USER) and p[0]), key=lambda p: -p[1])
    return {p[0]: p[1] if model.kind == UNIGRAM else -(PIECE_COST + math.log(2 + i)) for i, p in enumerate(own)}


class PieceTable:
    """Scores of pieces by polynomial hash, a sorted table for each length."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[str, float]):
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, score in scores.items():
            value = 0
            for c in piece:
                value = (value * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            by_length.setdefault(len(piece), []).append((value, score))
        self.scores, self.longest = scores, max(by_length)
        self.tables = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([s for _, s in sorted(x)])) for n, x in by_length.items()}
        self.powers = np.array([pow(int(self.BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)

    def find(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of them are pieces, these pieces' scores)."""
        known, scores = self.tables[length]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        return hit, scores[at[hit]]


def trie_counts(words: list[str], table: PieceTable, unknown: float, byte_fallback: bool) -> np.ndarray:
    """Tokens of each of the words (in ascending order, distinct, not empty). The trie is walked level by level: a node is
    a distinct prefix, its forward score and count are computed once from its ancestors', all nodes of a level together."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    start = np.cumsum(length) - length
    levels: list[tuple] = [(np.zeros(n, np.int32), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64))]  # a word's node; scores, counts, prefixes of nodes
    heads = np.zeros(n, bool)  # does a word start a node of its own?
    heads[0] = True
    rows, depth, out = np.arange(n), 0, np.zeros(n, np.int64)
    while True:
        depth += 1
        rows = rows[length[rows] >= depth]
        if len(rows) <= FEW:
            for i in rows.tolist():
                out[i] = _along(words[i], depth, [(float(s[at[i]]), int(c[at[i]])) for at, s, c, _ in levels], table, unknown, byte_fallback)
            return out
        char = flat[start[rows] + depth - 1]
        new = heads[rows] | (length[rows - 1] < depth)
        same = np.flatnonzero(~new)
        new[same] = char[same] != flat[start[rows[same] - 1] + depth - 1]
        heads[rows] = new
        node = np.zeros(n, np.int32)
        node[rows] = np.cumsum(new) - 1
        first, c = rows[new], char[new]
        above = levels[-1][0][first]
        hashed = levels[-1][3][above] * table.BASE + c.astype(np.uint64) + np.uint64(1)
        size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000) if byte_fallback else 1
        best, tokens = levels[-1][1][above] + unknown, levels[-1][2][above] + size
        for k in range(1, len(levels) + 1):
            if k not in table.tables:
                continue
            at, score, count, prefix = levels[-k]
            at = at[first]
            hit, value = table.find(hashed - prefix[at] * table.powers[k], k)
            reached, after = score[at[hit]] + value, count[at[hit]] + 1
            better = (reached > best[hit]) | ((reached == best[hit]) & (after < tokens[hit]))
            best[hit[better]], tokens[hit[better]] = reached[better], after[better]
        levels = [*levels[-table.longest + 1 :], (node, best, tokens, hashed)] if table.longest > 1 else [(node, best, tokens, hashed)]
        ends = rows[length[rows] == depth]
        out[ends] = tokens[node[ends]]  # terminal nodes store their count


def _along(word: str, depth: int, above: list[tuple[float, int]], table: PieceTable, unknown: float, byte_fallback: bool) -> int:
    """Tokens of a word from the scores and counts of its last prefixes of fewer than `depth` characters."""
    best = [(s, -c) for s, c in above]
    for end in range(depth, len(word) + 1):
        own = len(word[end - 1].encode("utf-8", "surrogatepass")) if byte_fallback else 1
        found = [(best[-1][0] + unknown, best[-1][1] - own)]
        for k in range(1, len(best) + 1):
            if (score := table.scores.get(word[end - k : end])) is not None:
                found.append((best[-k][0] + score, best[-k][1] - 1))
        best = [*best[-table.longest + 1 :], max(found)] if table.longest > 1 else [max(found)]
    return -best[-1][1]


class TrieCounter(dict):
    """pre-token (with a space for the mark) -> tokens."""

    def __init__(self, model: PieceModel, held: int = 400_000, longest: int = 64):
        super().__init__()
        scores = unigram_scores(model)
        self.held, self.longest, self.byte_fallback, self.prefix = held, longest, model.byte_fallback, b" " if model.dummy_prefix else b""
        self.table, self.unknown, self.runs = PieceTable(scores), min(scores.values()) - 10, model.runs()
        if self.runs is None:
            raise ValueError("the model's texts don't fall into independent runs")

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self) > self.held:
            self.clear()
        split = [self.runs.findall(self.prefix + spaces(t)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self)
        if new:
            words = sorted(w.decode().replace(" ", MARK) for w in new)
            self.update(zip((w.replace(MARK, " ").encode() for w in words), trie_counts(words, self.table, self.unknown, self.byte_fallback).tolist(), strict=True))
        out = [(len(t.split()), sum(map(self.__getitem__, runs))) for t, runs in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > self.longest:  # hardly met again
                del self[w]
        return out


@functools.lru_cache(2)
def counter(path: str) -> TrieCounter:
    """One counter for all tasks that a Python worker runs."""
    return TrieCounter(PieceModel.parse(Path(path).read_bytes()))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""

    def run(batches):
        own = counter(path)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                got = np.array(own.count([x or b"" for x in as_bytes(part.column(1))]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
