"""Top-k search, chat formatting and the pipeline."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerlark.llm import chat, topk


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [math.nan] * 12), (403, [math.inf] * 12), (404, [1.0] * 3), (405, [2.0] * 3), (None, rows[0][1]), (420, [0.5] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("rank", "rank")
    kept = {x.vec_id: [math.floor(64 * y) for y in x.embedding] for x in table.collect() if x.vec_id is not None and x.embedding and all(y is not None and math.isfinite(y) for y in x.embedding)}
    want = []
    for q, v in kept.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in kept.items() if c != q and len(w) == len(v))
            want += [(q, i, c, -s) for i, (s, c) in enumerate(scored[:20], 1)]
    for sizes in ({}, {"cand_block": 64, "query_rows": 5, "dim_block": 3}, {"cand_block": 16, "query_rows": 7, "growth": 2}):
        got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(table, **sizes).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark):
    """Products above 2^53, in several rounds, with near and exact ties."""
    r = random.Random(5)
    rows = [(i, [float(r.randrange(2_000_000, 5_000_000)) for _ in range(6)]) for i in range(60)] + [(60 + i, [4e6, 3e6, 4e6, 3e6, 4e6, 3e6 + i % 2]) for i in range(60)]
    ints = {i: [int(64 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 120, 20):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], w, strict=True)), c) for c, w in ints.items() if c != q)
        want += [(q, i, c, -s) for i, (s, c) in enumerate(scored[:4], 1)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, cand_block=16, growth=2, dim_block=2)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_thresholds_of_queries():
    """A block returns nothing below the score that a query brings along, and equal scores."""
    cands = np.arange(40)[:, None] * np.ones((1, 4), np.int64)
    found = topk.search_block(np.array([100, 101]), np.ones((2, 4), np.int64), np.arange(40), cands, 5, 2, 8, np.array([148, 1000]))
    assert found == [(100, 39, 156), (100, 38, 152), (100, 37, 148)]


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "<|turn|>", "<\\|end|>", "<\\\\|text|><", "", None, "é\n<|"]
    rows = [(c, t, r, x) for c in range(5) for t, (r, x) in enumerate((("user", "assistant", "system")[(c + i) % 3], hard[(c + i) % 7]) for i in range(9))]
    rows += [(None, 0, "assistant", "lone"), (7, None, None, "a"), (7, 1, "assistant", "b"), (7, 1, "assistant", "b"), (7, 1, "as<|text|>", "c")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(table)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_damaged_chat_is_refused():
    with pytest.raises(ValueError):
        chat.parse(b"<|turn|>user<|text|>a<|end|>b")


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before
        before = after
    assert len(before) < 200
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == before
