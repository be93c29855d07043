"""run() of the pipeline against plain versions of its stages: every pair compared, every window looked up, best fit
one piece after another."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from ledgerlark.llm import quality
from tests.llm.test_text_operators import WORD, _groups_by_brute_force, plain_best_fit, plain_repeats

SIZE = 2048


def rows_and_labels():
    r = random.Random(11)
    word = lambda: f"word{r.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    template, passage, copy = text(180), text(60), " ".join(text(80))
    rows: list[tuple] = []
    for i in range(600):
        kind, words = i % 3, text(60)
        if kind == 0:
            words[7], words[30] = "Idiot,", "scum"
        elif kind == 1:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
    for i in range(600, 660):  # a hot template: unrelated texts at 0.75, some planted pairs above 0.8
        tail = text(34)
        rows.append((2 * i, " ".join(template + tail)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(template + tail[:20] + text(14))))
    rows += [(2000 + i, copy.title() if i % 2 else copy) for i in range(50)]  # copies but for case
    for i in range(30):
        rows.append((2100 + i, "\n".join([" ".join(text(20)), " ".join(passage), "  " + " ".join(text(15 + i))])))
    chain = text(120)
    for i in range(8):
        rows.append((2200 + i, " ".join(chain)))
        chain = chain[5:] + text(5)
    rows += [(2300, " ".join(text(2500))), (2301, " ".join(passage)), (2302, None), (2303, ""), (2304, " \n"), (2305, "word7"), (None, " ".join(text(30))), (2306, "x" * 9000), (2, rows[2][1])]
    labels = [(i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(500)] + [(3, 1, 1), (None, 1, 0), (99999, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame([(*r, "en", 7, "a", "b") for r in rows], "doc_id long, text string, lang string, sequence_id int, _cover string, _of_id string")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_run_is_its_plain_version(spark, folder):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, quality.graded(labels))
    rows, _ = rows_and_labels()
    texts = [(x or "").encode() for _, x in rows]
    tail = model.above(model.score(texts, quality.WordSlots(model.bits)))[:, 1]
    kept = [row for row, p in zip(rows, tail, strict=True) if p >= quality.LEAST]
    ids = {k for k, _ in kept}
    assert {i for i in range(600) if i % 3 == 2} <= ids and not {i for i in range(600) if i % 3 < 2} & ids and {1200, 2000, 2100, 2200} <= ids

    of = _groups_by_brute_force([(k, x or "") for k, x in kept if k is not None])
    assert {k for k in of if k >= 1200}, "no near-duplicates planted"
    kept = [(k, x) for k, x in kept if k not in of]
    assert sum(2000 <= (k or 0) < 2050 for k, _ in kept) == 1 and sum(1200 <= (k or 0) < 1320 for k, _ in kept) == 60

    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    left = defaultdict(list)
    for k, n, gone, words in plain_repeats(kept, 50):
        left[k].append((n, gone, words.split()))
    assert sum(gone > 0 for x in left.values() for _, gone, _ in x) >= 29
    found = {}
    for r in pipeline.run(spark, folder).collect():
        found.setdefault((r.doc_id if r.doc_id is not None else -1), []).append(r)
    for k, x in kept:
        k = k if k is not None else -1
        n, gone, words = left[k][0]
        if n and n == gone:
            assert k not in found
        elif not gone:
            tokens = np.array(whole.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
            want += [(k, i, at, len(tokens[at : at + SIZE]), zlib.crc32(tokens[at : at + SIZE])) for i, at in enumerate(range(0, len(tokens), SIZE))]
    uncut = {k for k, *_ in want}
    assert sorted((k, r.piece, r.start, r.length, r.ids_crc32) for k in uncut for r in found[k]) == sorted(want)
    assert set(found) == {k if k is not None else -1 for k, _ in kept} - {k for k, x in left.items() if x[0][0] and x[0][0] == x[0][1]}

    cut = dict(kept)
    docs_after = docs
    for _, stage in pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs_after, folder)
        assert docs_after.columns == docs.columns
    for r in docs_after.collect():
        assert WORD.findall(r.text or "") == left[r.doc_id if r.doc_id is not None else -1][0][2]
        assert (r._cover, r._of_id, r.sequence_id) == ("a", "b", 7) and (r.text == cut[r.doc_id] or left[r.doc_id][0][1])

    by = defaultdict(list)
    for own in found.values():
        for r in own:
            by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= SIZE
    assert len(by) == plain_best_fit([r.length for own in found.values() for r in own], SIZE)


def test_run_on_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as pipeline

    for n in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
