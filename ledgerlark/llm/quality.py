"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades in order, 0 to K - 1. One weight vector over hashed text features is shared by all grades; ordered
thresholds t_0 < ... < t_(K-2) cut its score: P(grade <= k) = sigmoid(t_k - score). Outcomes: the expected grade (the
sum of P(grade > k)) and the tail probability P(grade >= wanted), by which documents are selected.

Features of a text (all of it; words are runs without ASCII white space): the presence of each word, lower-cased in
A-Z and without leading and trailing ASCII punctuation, and of its stems of 4 and 5 bytes; shares of words by shape
(case, last bytes that are no letters) and of words that repeat the one before; all hashed into 2^bits slots. Shares do
not depend on a text's length. Presence counts only in slots that tell grades apart by several standard errors, as
rare words would else be learned by heart.

Training takes at most `sample` labelled documents (those with the least hash of doc_id, a documented bound: their
features are what goes to the driver), in full-batch steps with Adam from fixed zeros, so equal tables give equal
models. Scoring reads every document where it lies and moves no text.

Null text: an empty one. Labels with a null rating or no document are not used; a document with two grades counts for
both, a repeated label or a repeated row of a document once (of rows that differ in text, the one with the least features).
With no labelled documents, or only one grade, scores are 0 and the thresholds alone decide: the tail probability is
then the share of such grades (1 where there are no labels), so everything is kept rather than dropped unseen.
Only doc_id, text and the labels' columns are read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes, lean

BITS, SAMPLE, SHARE_SCALE, LEAST = 18, 6000, 6.0, 0.5
_PUNCTUATION = string.punctuation.encode()


class WordSlots(dict):
    """word -> row of `table` with its slots: bare form, two stems, shape. Known words are kept up to `held`."""

    def __init__(self, bits: int, held: int = 300_000):
        super().__init__()
        self.bits, self.held = bits, held
        self.table = np.empty((1024, 4), np.int32)

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_PUNCTUATION)
        tail = word[len(word.rstrip(_PUNCTUATION)) :][-2:] if bare else word[:2]
        case = b"U" if len(bare) > 1 and bare.isupper() else b"t" if bare[:1].isupper() else b"l"
        bare = bare.lower()
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        keys = (b"w" + bare, b"4" + bare[:4], b"5" + bare[:5], b"s" + case + tail)
        self.table[at] = [xxhash.xxh32_intdigest(k) & ((1 << self.bits) - 1) for k in keys]
        return at


def features(text: bytes, slots: WordSlots) -> tuple[np.ndarray, np.ndarray, int]:
    """(slots, values, how many of them stand for presence; the others are shares)."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), 0
    if len(slots) > slots.held:
        slots.clear()
    at = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
    distinct, n = np.unique(at, return_counts=True)
    rows = slots.table[distinct]
    seen = np.unique(rows[:, :3])
    shape, of = np.unique(rows[:, 3], return_inverse=True)
    repeats = xxhash.xxh32_intdigest(b"repeats") & ((1 << slots.bits) - 1)
    share = np.append(np.bincount(of, n) / len(words), (at[1:] == at[:-1]).mean() if len(words) > 1 else 0.0)
    return np.concatenate([seen, shape, [repeats]]).astype(np.int64), np.concatenate([np.ones(len(seen)), SHARE_SCALE * share]).astype(np.float32), len(seen)


def telling(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: np.ndarray, bits: int, least: float = 5.0) -> np.ndarray:
    """Which slots to use: those whose texts' mean grade differs from the overall mean by `least` standard errors
    (presence), and all that hold shares."""
    seen, of = np.concatenate([r[0][: r[2]] for r in rows]), np.repeat(np.arange(len(rows)), [r[2] for r in rows])
    n = np.bincount(seen, minlength=1 << bits)
    drift = np.bincount(seen, weights=(grades - grades.mean())[of], minlength=1 << bits)
    out = np.abs(drift) > least * max(grades.std(), 1e-9) * np.sqrt(np.maximum(n, 1))
    out[np.concatenate([r[0][r[2] :] for r in rows])] = True
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (row) and threshold (column)."""
        return _sigmoid(scores[:, None] - self.thresholds)

    def score(self, texts: list[bytes], slots: WordSlots) -> np.ndarray:
        out = np.empty(len(texts))
        for i, x in enumerate(texts):
            at, value, _ = features(x, slots)
            out[i] = float((self.weights[at] * value).sum(dtype=np.float64))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: np.ndarray, classes: int, bits: int = BITS, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge. rows: features() of each text; grades: 0 to classes - 1."""
    grades = np.asarray(grades, np.int64)
    shares = np.array([(grades > k).mean() if len(grades) else 1.0 for k in range(classes - 1)])
    thresholds = np.maximum.accumulate(-np.log(np.clip(shares, 1e-6, 1 - 1e-6) / np.clip(1 - shares, 1e-6, 1)) + 1e-3 * np.arange(classes - 1))
    weights = np.zeros(1 << bits)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(weights.astype(np.float32), thresholds, bits)
    use = telling(rows, grades, bits)
    flat, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])[use[flat]]
    flat, value = flat[use[flat]], value[use[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    balance = (len(grades) / (classes * np.maximum(1, np.bincount(grades, minlength=classes))))[grades]
    cuts = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])  # first, then logs of the gaps
    theta = np.concatenate([np.zeros(len(used)), cuts])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, c = theta[: len(used)], theta[len(used) :]
        t = np.cumsum(np.concatenate([c[:1], np.exp(c[1:])]))
        score = np.bincount(of, w[flat] * value, minlength=len(rows))
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        high, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p * balance, low * (1 - low) / p * balance
        pull = (d_high - d_low) / len(rows)  # of the negative log-likelihood by score
        grad_t = np.array([(d_low[grades == k + 1].sum() - d_high[grades == k].sum()) / len(rows) for k in range(classes - 1)])
        grad_c = np.concatenate([[grad_t.sum()], [np.exp(c[k]) * grad_t[k:].sum() for k in range(1, classes - 1)]])
        grad = np.concatenate([np.bincount(flat, pull[of] * value, minlength=len(used)) + decay * w, grad_c])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = theta[: len(used)]
    c = theta[len(used) :]
    return OrdinalModel(weights.astype(np.float32), np.cumsum(np.concatenate([c[:1], np.exp(c[1:])])), bits)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 of good quality. A null flag counts as not set; without a quality
    and not toxic: no grade."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality").isNotNull(), F.when(F.col("quality") > 0, 2).otherwise(1))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")


def train(docs: DataFrame, grades: DataFrame, classes: int = 3, sample: int = SAMPLE, bits: int = BITS, **how) -> OrdinalModel:
    """Fit on at most `sample` rows of grades(doc_id, grade)."""
    chosen = grades.select("doc_id", "grade").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers

    def run(batches):
        slots = WordSlots(bits)
        for b in batches:
            got = [features(x or b"", slots) for x in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int32())], ["doc_id", "grade", "slots", "vals", "seen"])

    found = joined.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, slots binary, vals binary, seen int")
    first = found.groupBy("doc_id", "grade").agg(F.min(F.struct("slots", "vals", "seen")).alias("x"))  # `sample` rows at most, however often a document is there
    rows = first.select("doc_id", "grade", "x.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["grade"]))
    return fit([(np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["vals"], np.float32), r["seen"]) for r in rows], np.array([r["grade"] for r in rows]), classes, bits, **how)


def rated(docs: DataFrame, model: OrdinalModel, wanted: int = 2) -> DataFrame:
    """(doc_id, expected_grade, tail_probability) of every row; tail: grade >= wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers

    def run(batches):
        own = sent.value
        slots = WordSlots(own.bits)
        for b in batches:
            above = own.above(own.score([x or b"" for x in as_bytes(b.column(1))], slots))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, wanted - 1])], ["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def selected(docs: DataFrame, model: OrdinalModel, wanted: int = 2, least: float = LEAST) -> DataFrame:
    """The rows of docs whose tail probability is at least `least`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        own = sent.value
        slots = WordSlots(own.bits)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = [x or b"" for x in as_bytes(part.column(place).cast(pa.string()))]
                yield part.filter(pa.array(own.above(own.score(texts, slots))[:, wanted - 1] >= least))

    return docs.mapInArrow(lean(run), docs.schema)
