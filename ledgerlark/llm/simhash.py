"""SimHash fingerprints, their links and their groups.

Fingerprints. Text: A-Z lower-cased, words are runs without ASCII white space, shingles of `words` words joined by a
space (a shorter text: its whole word sequence; no word: fingerprint 0). Each shingle counts as often as it occurs;
its hash is XXH64 of the UTF-8 bytes. A bit of the fingerprint is set if it is set in over half of the hashes.

Links: two fingerprints that differ in at most 2 bits. They are found by a range join in a small grid: a fingerprint
is mapped to the counts of set bits in its 16 segments of 4 bits. One differing bit moves one count by one, so the
Manhattan distance of the count vectors is at most the Hamming distance; fingerprints within 2 bits lie at most 2 apart
in the grid, and some grid point is at most 1 from both. Each distinct fingerprint visits its own point and the up to 32
next to it; points with one visitor hold no link and go. For the rest the bound is made exact without comparing
visitors in pairs: two fingerprints differ in at most 2 bits just if some 64-bit word is within 1 bit of both, so
visitors name the words at that grid point that are within 1 bit of them, and those that name the same word link to the
least of them. At most 65 fingerprints can name a word. The work is linear in the distinct fingerprints, whatever
their crowding; no pair is lost.

Groups: components of the links. Equal fingerprints are one node, so thousands of copies cost one row.

Null texts count as empty. Rows with a null doc_id get a fingerprint and a component like others, but a component is
named by its least doc_id that is not null. Repeated rows stay repeated. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import as_bytes, lean, materialise
from ledgerlark.llm.components import connected_components

SEGMENTS, SEGMENT_BITS, COUNT_BITS = 16, 4, 3
_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # value of a byte, bit
_PIECE = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    found = text.lower().split()
    n = len(found) - words + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    shingles = map(b" ".join, zip(*(found[i : n + i] for i in range(words)), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, unsigned."""
    counts = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), _PIECE):
        lanes = hashes[i : i + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(x or b"", words, seed)) for x in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _counts(fp) -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * j).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long") for j in range(SEGMENTS)]


def grid_points(fps: DataFrame) -> DataFrame:
    """(fp, own, point): the packed count vector of each fp, and each grid point within Manhattan distance 1 of it."""
    own = sum((F.shiftleft(c, COUNT_BITS * j) for j, c in enumerate(_counts(F.col("fp")))), F.lit(0).cast("long"))
    digit = lambda j: F.shiftright(F.col("own"), COUNT_BITS * j).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    near = [F.col("own")]
    for j in range(SEGMENTS):
        step = F.lit(1 << (COUNT_BITS * j)).cast("long")
        near += [F.when(digit(j) < SEGMENT_BITS, F.col("own") + step), F.when(digit(j) > 0, F.col("own") - step)]
    return fps.select("fp", own.alias("own")).select("fp", "own", F.explode(F.array(*near)).alias("point")).where("point is not null")


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct values in a column fp. Returns (a, b): edges between fingerprints that differ in 1 or 2 bits,
    enough of them to join all that are joined by such differences."""
    points = grid_points(fps)
    met = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("point").hint("merge")
    rest = points.join(met, "point")
    segment = F.expr(f"cast(round(log2(abs(point - own))) as int) div {COUNT_BITS}")
    names = F.expr(
        f"""if(point = own, array(fp), transform(filter(sequence(0, {SEGMENT_BITS - 1}),
            i -> ((shiftrightunsigned(fp, {SEGMENT_BITS} * segment + i) & 1) = 0) = (point > own)),
            i -> fp ^ shiftleft(1L, {SEGMENT_BITS} * segment + i)))"""
    )
    words = rest.withColumn("segment", F.when(F.col("point") != F.col("own"), segment)).select("fp", F.explode(names).alias("word"))
    joined = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    edges = joined.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_copies(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    own = materialise(fingerprints(docs, words, seed))
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    in_group = nodes.join(of.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = in_group.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(in_group.join(first.hint("merge"), "component").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingles of a text as 64-bit hashes made of word hashes."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64)
    if not len(found):
        return found
    n = max(1, len(found) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(found))):
        out = (out ^ (out >> np.uint64(31))) * _STEP + found[i : i + n]
    return np.unique(out ^ (out >> np.uint64(29)))


def _samples(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A SimHash for each band: of the three shingles that are least under three orders of the band's own."""
    factors = np.random.default_rng(20240607).integers(1, 1 << 63, 3 * bands, dtype=np.uint64) | np.uint64(1)
    least = np.array([hashes[((hashes ^ (hashes >> np.uint64(32))) * f).argmin()] for f in factors]).reshape(bands, 3)
    a, b, c = least.T
    return (a & b) | (b & c) | (a & c)


def _sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(doc_id, content, fp, samples, size): content tells word sequences apart, fp is the whole text's fingerprint, size
    the number of its distinct shingles."""

    def run(batches):
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            content, fps, samples, sizes = [], [], [], []
            for x in as_bytes(b.column(1)):
                text = b" ".join((x or b"").lower().split())
                own = _shingle_set(text, words)
                content.append(xxhash.xxh128_digest(text))
                fps.append(fingerprint(own))
                samples.append(_samples(own, bands).view(np.int64) if len(own) else [])
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(content, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(samples, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "content", "fp", "samples", "size"]
            )

    return docs.mapInArrow(lean(run), "doc_id long, content binary, fp long, samples array<long>, size long")


def _sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the documents asked for: their shingle sets as sorted 32-bit hashes."""
    texts = docs.join(asked.distinct().hint("merge"), "doc_id", "left_semi")  # one plan at every size

    def shingle(batches):
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sets = [np.unique(_shingle_set(x or b"", words).astype("<u4")).tobytes() for x in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return materialise(texts.select("doc_id", "text").mapInArrow(lean(shingle), "doc_id long, shingles binary").dropDuplicates(["doc_id"]))


def _similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")).hint("merge"), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")).hint("merge"), "b").select("a", "b", "of_a", "of_b")

    def verify(batches):
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(common >= similarity * (len(merged) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(verify), "a long, b long")


FEW, BLOCK, BLOCK_SHINGLES, RARE = 8, 1024, 1 << 22, 16


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have at least that Jaccard similarity, every pair compared, as a symmetric matrix. Common
    shingles are counted for all pairs at once: rare ones by the pairs that have them, the others by a product."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    token, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    times = np.diff(np.append(start, len(token)))
    of = np.repeat(np.arange(len(start)), times)
    common = np.zeros((n, n), np.float32)
    rare = (times > 1) & (times <= RARE)
    t, o = of[rare[of]], owner[rare[of]]
    for d in range(1, RARE):
        at = np.flatnonzero(t[d:] == t[:-d])
        np.add.at(common, (o[at], o[at + d]), np.float32(1))
    often = times > RARE
    column = (np.cumsum(often) - 1)[of[often[of]]]
    o = owner[often[of]]
    for low in range(0, int(often.sum()), 512):
        i, j = np.searchsorted(column, [low, low + 512])
        has = np.zeros((n, 512), np.float32)
        has[o[i:j], column[i:j] - low] = 1
        common += has @ has.T
    out = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        part = common[i : i + 256].astype(np.float64)
        out[i : i + 256] = part >= similarity * (size[i : i + 256, None] + size - part)
    out = np.triu(out, 1)
    return out | out.T


def _crowds(sets: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """crowded(node, band, sample, n, shingles): members of large buckets. Returns (a, b): edges that join the members
    of a bucket as its similar pairs do. A bucket is dealt into blocks, and every two blocks meet in one group, where all
    pairs are compared."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = crowded.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(node, band), blocks) as int)"))
    meets = F.expr("if(blocks = 1, array(struct(0 as i, 0 as j)), transform(filter(sequence(0, blocks - 1), k -> k <> block), k -> struct(least(k, block) as i, greatest(k, block) as j)))")
    dealt = own.select("node", "band", "sample", F.explode(meets).alias("at")).select("node", "band", "sample", "at.i", "at.j")
    held = dealt.join(sets.withColumnRenamed("doc_id", "node").hint("merge"), "node").select("band", "sample", "i", "j", "node", "shingles")

    def join(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        near = _alike([np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()], similarity)
        left, a, b = np.ones(len(nodes), bool), [], []
        for root in range(len(nodes)):
            front = np.array([root]) if left[root] else np.array([], np.int64)
            while len(front):
                left[front] = False
                front = np.flatnonzero(near[front].any(axis=0) & left)
                a.append(np.full(len(front), nodes[root]))
                b.append(nodes[front])
        return pa.table({"a": np.concatenate(a).astype(np.int64), "b": np.concatenate(b).astype(np.int64)})

    return held.groupBy("band", "sample", "i", "j").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 12) -> DataFrame:
    """(doc_id, stays): documents that duplicate another one, and the least doc_id of their group.

    Duplicates are texts of one word sequence (A-Z lower-cased), and texts whose sets of `words`-word shingles have at
    least that Jaccard similarity; groups are components of these. At 0.8 the fingerprints of whole texts differ in up
    to 15 bits, where no grid is selective. So candidates come from fingerprints within 2 bits, by the grid, and from
    `bands` further fingerprints a text, each the SimHash of three of its shingles, drawn by min-wise hashing: two texts
    of similarity s agree on one with s^3, at 0.8 on at least one of 12 with 0.9998. All who agree on one are compared
    with each other on the shingle sets themselves: up to FEW of them as candidate pairs, more of them in blocks of about
    BLOCK texts, where a block pair is one group. So rows grow with the square of such a bucket's distinct texts over
    BLOCK, and comparisons with their square; no pair that agrees is left out.

    Null doc_ids are in no group. Rows that repeat a doc_id are one document. Empty texts are one word sequence."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketched = materialise(_sketches(own, words, bands))
    nodes = materialise(sketched.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("samples").alias("samples"), F.first("size").alias("size")))
    by_fp = nodes.where("size(samples) > 0").groupBy("fp").agg(F.min("node").alias("node"))
    met = links(by_fp.select("fp")).join(by_fp.select(F.col("fp").alias("a"), F.col("node").alias("of_a")).hint("merge"), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("node").alias("of_b")).hint("merge"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    sampled = nodes.select("node", "size", F.posexplode("samples").alias("band", "sample"))
    buckets = sampled.groupBy("band", "sample").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    agreed = materialise(sampled.join(buckets.hint("merge"), ["band", "sample"]))
    few = agreed.where(F.col("n") <= FEW).groupBy("band", "sample").agg(F.sort_array(F.collect_list("node")).alias("x"))
    few = few.select("x", F.posexplode("x").alias("i", "a")).select("a", F.explode(F.expr("slice(x, i + 2, size(x))")).alias("b"))
    pairs = materialise(met.union(few).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    crowded = agreed.where(F.col("n") > FEW).select("node", "band", "sample", "n", "shingles")
    sets = _sets(own, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(crowded.select("node")), words)
    same = connected_components(materialise(_similar(sets, pairs, similarity).union(_crowds(sets, crowded, similarity))))
    of = nodes.select("content", "node").join(same.hint("merge"), "node", "left").select("content", F.coalesce("component", "node").alias("stays"))
    return sketched.select("doc_id", "content").join(of.hint("merge"), "content").where("doc_id <> stays").groupBy("doc_id").agg(F.min("stays").alias("stays"))
