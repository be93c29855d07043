"""Operators on documents against plain versions, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerlark.llm import licenses, media, packing, pieces, quality, queries, simhash, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, media string, kept string, component_id long, tag long, sequence_id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta,", "gamma.", "été", "naïve", "x1", "don't", "über", "中文", "of", "the"]
    shared = " ".join(r.choice(words) + str(i) for i in range(70))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) + r.choice(["", str(r.randrange(9))]) for _ in range(r.randrange(1, 150)))
        if i % 4 == 0:
            text = text[: r.randrange(1, 60)] + " " + shared + "\n" + text[-20:]
        if i % 10 == 9:
            text = rows[i - 5][1]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "two words"), (None, rows[0][1]), (3, rows[3][1]), (105, "z" * 5000), (106, "<|endoftext|> <|TURN|>\x00\x01")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "m", "k", 1, 2, 3) for r in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, none):
    got = media.decode_column(media.encode_column(docs)).collect()
    want = sorted((k if k is not None else -1, x or "") for k, x in corpus())
    assert len(got) == len(want)
    by = defaultdict(set)
    for row in got:
        by[row.doc_id].add((row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32))
    for k, x in corpus():
        payload = media.pad((x or "").encode())
        assert (len((x or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) in by[k]
    assert len(media.pad(b"")) == 64 and media.decode_column(media.encode_column(none)).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_and_damage(kind):
    payload = media.pad(random.Random(kind).randbytes(5000))
    stored = media.encode(payload, kinds=(kind,))
    assert media.decode(stored).tobytes() == payload
    broken = bytearray(stored)
    broken[60] ^= 1
    for bad in (bytes(broken), stored[:-3], b"x" + stored[1:]):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[top(i)] = top(j)
    return [top(i) for i in range(n)]


def test_simhash_components(docs, none):
    rows = corpus()
    fps = [plain_fingerprint(x) for _, x in rows]
    group = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = defaultdict(list)
    for g, (k, _) in zip(group, rows, strict=True):
        if k is not None:
            least[g].append(k)
    want = sorted((k if k is not None else -1, f, min(least[g])) for g, f, (k, _) in zip(group, fps, rows, strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_copies(docs).collect())
    assert got == want
    assert simhash.near_copies(none).count() == 0


def test_links_lose_no_pair(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    group = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = [(x.a, x.b) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    at = {s: i for i, s in enumerate(signed)}
    edges = {(at[a], at[b]) for a, b in found} | {(at[b], at[a]) for a, b in found}
    again = components(len(fps), lambda i, j: (i, j) in edges)
    assert len({*zip(group, again, strict=True)}) == len(set(group)) == len(set(again))


def test_near_duplicates_at_080(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(4000)}" for _ in range(300)] for _ in range(12)]
    rows, want = [], {}
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 4):
            own = list(words)
            for at in r.sample(range(300), 4):
                own[at] = f"n{r.randrange(9999)}"
            rows.append((i * 10 + j, "\n".join(own)))
    sets = {k: {tuple(x.split()[i : i + 5]) for i in range(296)} for k, x in rows}
    keys = sorted(sets)
    group = components(len(keys), lambda i, j: len(sets[keys[i]] & sets[keys[j]]) >= 0.8 * len(sets[keys[i]] | sets[keys[j]]))
    want = {k for i, k in enumerate(keys) if any(group[j] == group[i] for j in range(i))}
    rows += [(500, None), (501, ""), (502, "short"), (503, "Short "), (None, "short")]
    got = {x.doc_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {501, 503}


def plain_repeats(rows, window):
    starts = defaultdict(set)
    for k, x in rows:
        w = WORD.findall(x or "")
        for i in range(len(w) - window + 1):
            if k is not None:
                starts[tuple(w[i : i + window])].add(k)
    out = []
    for k, x in rows:
        w = WORD.findall(x or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and min(starts[tuple(w[i : i + window])]) < k:
                gone |= set(range(i, i + window))
        out.append((k if k is not None else -1, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"group_windows": 50, "block_bytes": 1500}])
@pytest.mark.parametrize("window", [1, 3, 50])
def test_substrings(docs, none, window, sizes):
    found = substrings.without_repeats(docs, window, **sizes)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in found.collect())
    assert got == plain_repeats(corpus(), window)
    assert substrings.without_repeats(none).count() == 0


def group_sizes(texts, window, group_windows):
    """Suffixes that travel to each group, all texts in one block."""
    every = np.concatenate([np.lib.stride_tricks.sliding_window_view(substrings.symbols(t), window) for t in texts])
    sample = np.sort(np.ascontiguousarray(every[:: max(1, group_windows // substrings.SAMPLES_A_GROUP)]).view(f"S{window}").ravel())
    counts = np.bincount((every[:, 0].astype(np.int64) << 8) + every[:, 1], minlength=1 << 16)
    groups = substrings.Groups(counts, sample, window, group_windows)
    rows = substrings._block_rows(0, list(range(len(texts))), [0] * len(texts), list(texts), window, groups, max(1, groups.total))
    return {r[0]: len(r[4]) // 8 for r in rows if r[2] == substrings._SUFFIXES}, groups.total


def test_groups_are_bounded():
    r = random.Random(12)
    phrase = " ".join(f"w{i}" for i in range(4))
    same = [(" ".join([phrase] * 500)).encode() for _ in range(50)]
    sizes, _ = group_sizes(same, 50, 1000)
    assert sum(sizes.values()) == 4  # equal windows collapse
    opened = [" ".join(f"{phrase} {phrase} v{r.randrange(10**6)}" for _ in range(200)).encode() for _ in range(50)]
    sizes, total = group_sizes(opened, 50, 1000)
    assert sum(sizes.values()) > 80_000 and max(sizes.values()) <= 2000 and total < 300


def test_repeats_inside_one_document_follow_their_first(spark):
    phrase = " ".join(f"w{i}" for i in range(7))
    rows = [(1, " ".join([phrase] * 40)), (2, "x y " + " ".join([phrase] * 30) + " z"), (3, " ".join([phrase] * 12))]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"), 50, group_windows=20, block_bytes=100)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == plain_repeats(rows, 50)


def test_cut_repeats_keeps_columns(docs):
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns
    got = {(r.doc_id if r.doc_id is not None else -1, " ".join(WORD.findall(r.text or ""))) for r in cut.collect()}
    assert got == {(k, kept) for k, n, gone, kept in plain_repeats(corpus(), 50) if not n or n != gone}


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    size = 64
    rows = packing.pack(docs, path, size).collect()
    want, total = [], 0
    for k, x in corpus():
        ids = np.array(whole.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want += [(k if k is not None else -1, i, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size])) for i, at in enumerate(range(0, len(ids), size))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert math.ceil(total / size) <= len(by) <= plain_best_fit([w[3] for w in want], size)
    assert packing.pack(none, path).count() == 0


def sequential_best_fit(lengths, size):
    """(length, sequence, offset) of each piece in descending order, and the number of sequences."""
    gaps, out = [], []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: (gaps[i], i), default=None)
        if at is None:
            gaps.append(size)
            at = len(gaps) - 1
        out.append((n, at, size - gaps[at]))
        gaps[at] -= n
    return out, len(gaps)


def plain_best_fit(lengths, size):
    return sequential_best_fit(lengths, size)[1]


def test_best_fit_is_sequential_best_fit():
    r = random.Random(2)
    tables = [({150: 10, 50: 4}, 250), ({33: 59, 50: 54, 107: 17, 144: 52}, 256), ({}, 8), ({8: 3}, 8), ({1: 100}, 8)]
    for _ in range(1000):
        size = r.choice([8, 32, 100, 256])
        tables.append(({r.randrange(1, size + 1): r.randrange(0, 40) for _ in range(r.randrange(1, 12))}, size))
    for counts, size in tables:
        plan, opened = packing.best_fit(counts, size)
        got = []
        for n, rank, number, each, first, offset in plan:
            assert rank == sum(1 for g in got if g[0] == n)
            got += [(n, first + i // each, offset + i % each * n) for i in range(number)]
        want, sequences = sequential_best_fit([n for n, c in counts.items() for _ in range(c)], size)
        assert got == want and opened == sequences


def test_packing_by_slices_of_the_plan(docs, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = sorted(map(tuple, packing.pack(docs, path, 64).collect()), key=str)
    monkeypatch.setattr(packing, "PLAN_ROWS", 7)
    cut = sorted(map(tuple, packing.pack(docs, path, 64).collect()), key=str)
    assert [(*x[:5],) for x in cut] == [(*x[:5],) for x in whole] and len({x[5] for x in cut}) == len({x[5] for x in whole})


def test_pieces(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encoded(docs, path).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted((k if k is not None else -1, judge.encode(x or "")) for k, x in corpus())
    assert all(r.parity and r.round_trip for r in rows)
    assert pieces.encoded(none, path).count() == 0


ODD = ["a", "b ", " ", "▁", "\x00", "\n", "\t", "é", "中", "the", "<s>", "<0x41>", "\U0001f600", "\u0301", "Z" * 30, "\r", "ing", "\x7f", "."]


def odd_texts(n):
    r = random.Random(11)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 12))) for _ in range(n)]


def check_codec(own, texts):
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, (ids, same) in zip(part, own.encode([t.encode() for t in part]), strict=True):
            assert same and ids.tolist() == own.judge.encode(text), repr(text)
            assert own.decode(ids).decode() == own.judge.decode(ids.tolist()) == text.replace("▁", " "), repr(text)


def test_odd_texts_have_the_other_librarys_ids():
    check_codec(pieces.Codec(public_tokenizers.path("piece_bpe_32k.model")), odd_texts(3000))


def _proto(number, value):
    """One field of a protobuf message."""
    def varint(x):
        return bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model(tmp_path):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abthein") for _ in range(r.randrange(1, 5))) for _ in range(60)} | set("abthein.Z"))
    text = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    text += [(m + w, -r.uniform(1, 9), 1) for w in words for m in ("", "▁")] + [("▁", -3.0, 1), ("▁▁", -4.0, 1)]
    data = b"".join(_proto(1, _proto(1, p.encode()) + _proto(2, s) + _proto(3, k)) for p, s, k in text)
    data += _proto(2, _proto(3, 1) + _proto(35, 1)) + _proto(3, _proto(1, b"identity") + _proto(3, 1) + _proto(4, 0))
    (tmp_path / "u.model").write_bytes(data)
    own = pieces.Codec(str(tmp_path / "u.model"))
    assert own.by_run and own.model.kind == pieces.UNIGRAM
    check_codec(own, odd_texts(1000))
    counter = token_counts.TrieCounter(own.model)
    for t in odd_texts(1000):  # the file's scores: the same best sums, so the same counts but for ties
        assert counter.count([t.encode()])[0][1] == len(own.judge.encode(t)), repr(t)


def plain_count(run, scores, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] - len(run[end - 1].encode()))]
        options += [(best[i][0] + scores[run[i:end]], best[i][1] - 1) for i in range(max(0, end - 16), end) if run[i:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def plain_runs(text):
    return [x.replace(" ", "▁") for x in re.findall(r" *[^ \n]+|\n| +", " " + text.replace("▁", " "))] if text else []


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.unigram_scores(pieces.PieceModel.parse(open(path, "rb").read()))
    unknown = min(scores.values()) - 10
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    count = lambda x: sum(plain_count(w, scores, unknown) for w in plain_runs(x or ""))
    assert got == sorted((k if k is not None else -1, len(WORD.findall(x or "")), count(x)) for k, x in corpus())
    assert token_counts.token_counts(none, path).count() == 0
    odd = odd_texts(1500) + ["a\tb\tc\n" * 5, "x" * 200 + " " + "x" * 150 + "y", "\x00" * 50, "ab\x00 ab ab\x00\x00"]
    assert [n for _, n in token_counts.counter(path).count([t.encode() for t in odd])] == [count(t) for t in odd]


def plain_licenses(text, threshold=0.8):
    """(license, word, words, dice) of the passages of a text: every window of every template's size is compared."""
    w = licenses.normal(text)
    pairs, found = list(zip(w, w[1:], strict=False)), []
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        t = licenses.normal(notice)
        want = Counter(zip(t, t[1:], strict=False))
        m = sum(want.values())
        size = min(m, len(pairs))
        scored = [(2.0 * (Counter(pairs[s : s + size]) & want).total() / (m + size), s) for s in range(len(pairs) - size + 1)] if size else []
        if scored and max(scored)[0] >= threshold:
            found.append((*max(scored), size + 1, name, i))
    beats = lambda y, a: (-y[0], y[3], y[1], y[4]) < (-a[0], a[3], a[1], a[4]) and y[1] < a[1] + a[2] and a[1] < y[1] + y[2]
    return sorted((a[3], a[1] + 1, a[2], round(a[0], 9)) for a in found if not any(beats(y, a) for y in found))


def test_licenses(spark, none):
    r = random.Random(6)
    texts = ["x\nReleased under the MIT License.\ny", "licensed under the apache license version 2.0", "This work is licensed under the GNU General Public License, version 3. or so", "MIT", "", None, "under the under the under the MIT License", "Released under\nthe MIT\nLicense.", "Code: licensed under CC BY-NC 4.0, and under the terms of the Mozilla Public License 2.0", "SPDX-License-Identifier: Apache-2.0"]
    for _, notice in licenses.TEXTS:
        words = notice.split()
        for _ in range(r.randrange(2)):
            words[r.randrange(len(words))] = "Foo"
        texts += ["Intro of a file.\n" + "\n".join(words) + " the end of the", " ".join(words[: len(words) * 2 // 3]), "of the software " * 60 + " ".join(words)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = sorted((x.doc_id, x.license, x.word, x.n_words, round(x.dice, 9)) for x in licenses.scan(spark.createDataFrame([(*x, "clash", "w") for x in rows], "doc_id long, text string, license string, w string")).collect())
    assert got == sorted((k, *x) for k, t in rows for x in plain_licenses(t or ""))
    assert {x[1] for x in got} >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Zlib"}
    long = "alpha beta " * 100_000 + licenses._MIT
    assert [x.license for x in licenses.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()] == ["MIT"]
    assert licenses.scan(none).count() == 0 and licenses.scan(none, []).count() == 0


def test_quality(spark, none):
    r = random.Random(8)
    good = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        words = r.choices(good, k=60)
        if kind == 0:
            words[r.randrange(60)] = "Idiot,"
            words[r.randrange(60)] = "scum"
        elif kind == 1:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(kind != 1), int(kind == 0)))
    labels += [(None, 1, 0), (7, None, None), (9999, 1, 0)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    model = quality.train(docs, quality.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x for x in quality.rated(docs, model).collect()}
    held = [i for i in range(400, 600)]
    assert sum((got[i].tail_probability >= 0.5) == (i % 3 == 2) for i in held) >= 0.98 * len(held)
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.tail_probability >= 0.5}
    nobody = quality.train(docs, quality.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert quality.selected(docs, nobody).count() == docs.count()
    assert quality.rated(none, model).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def _groups_by_brute_force(rows, words=5, similarity=0.8):
    """doc_id -> least doc_id of its group; all pairs compared."""
    sets, stays = {}, {}
    for k, x in rows:
        w = x.lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
        stays[k] = k
    find = lambda k: k if stays[k] == k else find(stays[k])
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                stays[y] = x
    return {k: find(k) for k in sets if find(k) != k}


@pytest.mark.parametrize("block", [1024, 100])
def test_near_duplicates_of_templated_texts(spark, monkeypatch, block):
    """All texts share 180 shingles (0.75 between any two); planted pairs also share most of their own 30."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(3)
    shared = " ".join(f"t{i}" for i in range(184))
    rows = []
    for k in range(400):
        tail = [f"w{r.randrange(10**9)}" for _ in range(30)]
        rows.append((2 * k, shared + " " + " ".join(tail)))
        if k % 2 == 0:
            cut = r.choice([14, 17, 20])
            rows.append((2 * k + 1, shared + " " + " ".join(tail[:cut] + [f"v{r.randrange(10**9)}" for _ in tail[cut:]])))
    got = {x.doc_id: x.stays for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _groups_by_brute_force(rows)
    assert len(want) == 200 and got == want

NO_BROADCAST_ROWS = 300


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_near_copies_take_no_broadcast(spark):
    """The estimates of exploded rows are far too small: a table that Spark takes for 2 MB can fill the driver."""
    from ledgerlark.llm import components, simhash

    docs = spark.createDataFrame([(i, f"w{i % 97} x{i % 89} y{i % 83} z") for i in range(NO_BROADCAST_ROWS)], "doc_id long, text string")
    found = simhash.near_copies(docs)
    edges = spark.range(NO_BROADCAST_ROWS).selectExpr("id % 60 + 60 u", "id % 60 v")
    fps = docs.selectExpr("doc_id fp")
    for df in (found, simhash.links(fps), components._large_star(edges), components._small_star(edges)):
        assert not _broadcasts(df)
    assert found.count() == NO_BROADCAST_ROWS


def test_near_duplicates_take_no_broadcast(spark):
    docs = spark.createDataFrame([(i, f"w{i % 97} x{i % 89} y{i % 83} z") for i in range(NO_BROADCAST_ROWS)], "doc_id long, text string")
    assert not _broadcasts(simhash.near_duplicates(docs))


def test_tasks_of_other_operators_leave_nothing(tmp_path):
    from ledgerlark.llm._shared import lean

    packing.run_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert list(lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
    assert not packing.run_encoder.cache_info().currsize
