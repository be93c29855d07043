"""The queries of these operators over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import chat, licenses, media, packing, pieces, quality, simhash, substrings, token_counts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PNG in a binary column, and what is read back from it."""
    return media.decode_column(media.encode_column(_table(spark, sf_dir, "documents")))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids: their number and digest, parity with the other library, and the way back."""
    found = pieces.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "parity", "round_trip")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer bits."""
    found = simhash.near_copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 50 words that start in an earlier one too."""
    found = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens and their places in sequences of 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_table(spark, sf_dir, "labels")))
    found = quality.rated(docs, model)
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), (F.col("tail_probability") >= quality.LEAST).alias("keep"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates control strings, formatted and read back."""
    hard = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    both = turns.unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(both))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document that states a licence."""
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _licence_sql() -> str:
    """The scan by plain comparison of windows at every place with every template that shares enough bigrams."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(license)}, {quoted(text)})" for i, (license, text) in enumerate(licenses.TEMPLATES))
    words = "string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
        WITH t AS (SELECT idx, license, {words.format("notice")} AS w, len(w) - 1 AS m FROM (VALUES {rows}) v(idx, license, notice)),
        tb AS (SELECT idx, license, m, b, count(*) AS n FROM (SELECT idx, license, m, unnest(list_transform(range(1, m + 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM t) GROUP BY ALL),
        d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("text")} AS w, len(w) - 1 AS size FROM documents WHERE text IS NOT NULL),
        db AS (SELECT r, doc_id, size, unnest(range(0, size)) AS pos, unnest(list_transform(range(1, size + 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM d WHERE size > 0),
        hits AS (SELECT r, doc_id, size, pos, tb.* FROM db JOIN tb USING (b) QUALIFY count(*) OVER (PARTITION BY r, idx) >= {licenses.THRESHOLD} * (m + least(m, size)) / 2),
        placed AS (SELECT *, unnest(range(greatest(pos - m + 1, 0), least(pos, greatest(size - m, 0)) + 1)) AS s FROM hits),
        common AS (SELECT r, doc_id, size, idx, license, m, s, sum(c) AS c FROM (SELECT r, doc_id, size, idx, license, m, s, b, least(count(*), min(n)) AS c FROM placed GROUP BY r, doc_id, size, idx, license, m, s, b) GROUP BY ALL),
        best AS (SELECT r, doc_id, idx, license, s, least(m, size) + 1 AS k, 2.0::DOUBLE * c / (m + least(m, size)) AS dice FROM common WHERE 2.0::DOUBLE * c / (m + least(m, size)) >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, idx ORDER BY c DESC, s DESC) = 1)
        SELECT doc_id, license, CAST(s + 1 AS INTEGER) AS word, CAST(k AS INTEGER) AS n_words, round(dice, 6) AS dice FROM best a
        WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.r = a.r AND y.s < a.s + a.k AND a.s < y.s + y.k
            AND (y.dice > a.dice OR (y.dice = a.dice AND (y.license < a.license OR (y.license = a.license AND (y.s < a.s OR (y.s = a.s AND y.idx < a.idx)))))))
    """


QUERIES = {
    "op1_media": op1_media,
    "op2_pieces": op2_pieces,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_substrings": op5_substrings,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op9_licenses": _licence_sql(),
    "op4_topk": """
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM kept q JOIN kept c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
