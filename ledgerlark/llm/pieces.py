"""SentencePiece encoding and decoding with the `tokenizers` library.

The model's protobuf is parsed here (pieces, trainer and normaliser settings). From it are rebuilt: the normaliser
(identity, or the model's character map), the dummy prefix and the metaspace marker for spaces, the pieces' scores (as
unigram scores, or as the order of merges for a BPE model) and byte fallback.

No piece has the marker after another character, nor a character such as a line end that the vocabulary lacks; so a text
falls into runs (spaces with the characters after them; line ends) whose ids are independent. The marker character itself
counts as a space, as it does in the other library. Distinct runs are encoded in batches, in the library's threads, and
looked up from then on; each batch of new runs is also encoded by the sentencepiece library, and a document's `parity` says
whether all of its runs agreed. Documents with the marker character or control characters are held against that library as
a whole. With a unigram model, runs that spell the name of a byte's piece take that library's ids. decode() joins the pieces' bytes, so what it returns stands for the ids alone; `round_trip` says whether it is
the text. It isn't for texts that hold the marker character itself.

Null text: an empty one, without ids. Rows are independent, so nulls, repeats, ties and empty tables need no care.
Whole texts are encoded. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the format
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze_spaces = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces in the order in which they merge: by falling score of the piece they make."""
        order = {p: i for i, p in enumerate(sorted((p for p in self.pieces if p[2] in (NORMAL, USER)), key=lambda p: -p[1]))}
        known = {p[0] for p in order}
        return [(p[0][:k], p[0][k:]) for p in order for k in range(1, len(p[0])) if p[0][:k] in known and p[0][k:] in known]

    def tokenizer(self):
        """The model with the `tokenizers` library; it takes texts whose spaces are marks already."""
        from tokenizers import Tokenizer, models, normalizers

        if self.kind == UNIGRAM:
            # pieces that texts don't spell get names that can't occur (a mark behind another character), and no score
            # below the others'; bytes keep theirs, by which the library finds them
            least = min((p[1] for p in self.pieces if p[2] in (NORMAL, USER)), default=0.0)
            named = [(p[0] if p[2] in (NORMAL, USER, BYTE) else f"{p[0]}x{MARK}", p[1] if p[2] in (NORMAL, USER) else least) for p in self.pieces]
            model = models.Unigram(named, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            vocab = {p[0]: i for i, p in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if self.charsmap:
            out.normalizer = normalizers.Precompiled(self.charsmap)
        return out

    def runs(self) -> re.Pattern | None:
        """Finds the runs of a text's bytes (after spaces() and the dummy prefix) whose ids are independent; None if the
        model's pieces don't allow it."""
        text = [p[0] for p in self.pieces if p[2] in (NORMAL, USER)]
        if self.charsmap or self.squeeze_spaces or not self.byte_fallback or any(MARK in p.lstrip(MARK) or "\n" in p for p in text):
            return None
        return re.compile(rb" *[^ \n]+|\n| +")

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for in a text."""
        one = {CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        return [one.get(kind, lambda p: p.replace(MARK, " ").encode())(text) for text, _, kind in self.pieces]


_ODD = re.compile(MARK.encode() + rb"|[\x00-\x08\x0b-\x1f\x7f]")


def spaces(text: bytes) -> bytes:
    """text with the marker character, which stands for a space in these models, as a space."""
    return text.replace(MARK.encode(), b" ")


class Codec(dict):
    """Ids of texts by run: the dict has a run's place. Only models with byte fallback and without squeezing of spaces and
    character map are cut into runs; texts of others are encoded whole."""

    def __init__(self, path: str, held: int = 400_000, longest: int = 64, batch: int = 16384, joined: int = 256):
        super().__init__()
        import sentencepiece

        self.model = PieceModel.parse(Path(path).read_bytes())
        self.tokenizer, self.held, self.longest, self.batch = self.model.tokenizer(), held, longest, batch
        self.joined, self.line_end = joined, next((i for i, p in enumerate(self.model.pieces) if p[0] == "<0x0A>" and p[2] == BYTE), None)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.runs = self.model.runs()
        self.by_run = self.runs is not None
        self.meaning = self.model.piece_bytes()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.flat, self.start, self.agrees = array("I"), array("q", [0]), bytearray()

    def _learn(self, runs: list[bytes]) -> None:
        """Encodes new runs, joined by line ends to texts of `joined` runs: a line end is a piece of its own in either
        library, and both are asked for the same texts."""
        spelt = [r for r in runs if b"<0x" in r] if self.model.kind == UNIGRAM else []  # taken for a byte's piece
        known = {b"\n", *spelt}
        plain, prefix = [r for r in runs if r not in known], self.model.dummy_prefix
        for i in range(0, len(plain), self.batch):
            groups = [plain[j : j + self.joined] for j in range(i, min(i + self.batch, len(plain)), self.joined)]
            texts = [b"\n".join(g).decode().replace(" ", MARK) for g in groups]
            mine = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = [x[2:] for x in self.judge.encode(["\n" + t for t in texts], num_threads=1)] if prefix else self.judge.encode(texts, num_threads=1)
            for group, own, other in zip(groups, mine, theirs, strict=True):
                same = own == other
                own, other = np.array(own, np.uint32), np.array(other, np.uint32)
                ends, ends_there = (np.append(np.flatnonzero(x == self.line_end), len(x)) for x in (own, other))
                starts, starts_there = (np.append(0, e[:-1] + 1) for e in (ends, ends_there))
                if same:
                    agree = bytes([1]) * len(group)
                else:
                    agree = bytes(np.array_equal(own[a:b], other[c:d]) for a, b, c, d in zip(starts, ends, starts_there, ends_there, strict=True))
                self._keep(group, own[own != self.line_end], ends - starts, agree)
        if b"\n" in runs:
            self._keep([b"\n"], np.array([self.line_end], np.uint32), np.array([1]), b"\x01")
        for r in spelt:
            ids = np.array(self.judge.encode("\n" + r.decode())[2 if prefix else 1 :], np.uint32)
            self._keep([r], ids, np.array([len(ids)]), b"\x01")

    def _keep(self, runs: list[bytes], ids: np.ndarray, lengths: np.ndarray, agree: bytes) -> None:
        self.update(zip(runs, range(len(self.agrees), len(self.agrees) + len(runs)), strict=True))
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.start.frombytes((np.cumsum(lengths) + self.start[-1]).astype(np.int64).tobytes())
        self.agrees += agree

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity) of each text."""
        if not self.by_run:
            out = []
            for t in texts:
                text = t.decode()
                if self.model.squeeze_spaces:
                    text = re.sub(" +", " ", text).strip(" ")
                text = ((" " if self.model.dummy_prefix and text else "") + text).replace(" ", MARK)
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append((np.array(ids, np.uint32), ids == self.judge.encode(t.decode())))
            return out
        if len(self) > self.held or len(self.flat) > 16 * self.held:
            self.empty()
        split = [self.runs.findall((b" " if self.model.dummy_prefix else b"") + spaces(t)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self)
        self._learn(list(new))
        start, flat, agrees = np.array(self.start), np.array(self.flat), np.frombuffer(bytes(self.agrees), bool)
        out = []
        for t, runs in zip(texts, split, strict=True):
            at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
            n = start[at + 1] - start[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids, same = flat[np.arange(total) + np.repeat(start[at] - ends + n, n)], bool(agrees[at].all())
            if _ODD.search(t):
                same = ids.tolist() == self.judge.encode(t.decode())
            out.append((ids, same))
        for r in new:
            if len(r) > self.longest:  # hardly met again
                del self[r]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.meaning.__getitem__, ids.tolist()))
        return text[1:] if self.model.dummy_prefix and text[:1] == b" " else text


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for all tasks that a Python worker runs."""
    return Codec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, parity, round_trip); ids: little-endian unsigned 32-bit numbers."""
    names = ["doc_id", "n_tokens", "ids", "parity", "round_trip"]

    def run(batches):
        own = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [x or b"" for x in as_bytes(part.column(1))]
                got = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) for ids, _ in got], pa.int64()),
                        pa.array([ids.astype("<u4").tobytes() for ids, _ in got], pa.binary()),
                        pa.array([same for _, same in got], pa.bool_()),
                        pa.array([own.decode(ids) == t for (ids, _), t in zip(got, texts, strict=True)], pa.bool_()),
                    ],
                    names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, parity boolean, round_trip boolean"
    )


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
