"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aislefix.llm import (
    best_fit, chat, divergence, hard_negatives, html_text, language, mixing, order_minhash, packing, repetition, simhash, token_files, warc,
)
from aislefix.sources.tables import materialize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, profiles)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads are read and held against their digests; revisits carry those of their response."""
    folder = warc.write_warc(table(spark, sf_dir, "pages"))
    found = warc.read_warc(spark, folder, payload=False, verify=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 of the 160 bits: every five hexadecimal digits give four characters.
OP3_SQL = """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
    hashed AS (SELECT *, sha1(p) AS h, min(page_id) OVER (PARTITION BY sha1(p)) AS first_id FROM payloads)
    SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
           list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
               FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM hashed"""


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(spark, token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# The extra conversation of op10; a fixed value of the task.
TRICKY = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    formatted = materialize(chat.format_conversations(rows.unionByName(tricky)), "chat")
    return chat.read_back(formatted)


OP10_SQL = """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, t.turn, t.role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t (turn, role)
    ), formed AS (
        SELECT *, length('### : </turn>' || chr(10)) + length(role)
                  + length(replace(replace(replace(text, chr(92), chr(92) || 'b'), '#', chr(92) || 'h'), '<', chr(92) || 'l')) AS n
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM formed GROUP BY conv_id"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows.vec_id % 7 == 0, (rows.label + 1) % 10).otherwise(rows.label)
    rows = rows.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine_hard_negatives(rows, rows.vec_id % 100 == 0)


OP11_SQL = """
    WITH sound AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
    ), found AS (
        SELECT doc_id, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM docs
    ), kept AS (
        SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30
    ), uses AS (
        SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), groups AS (
        SELECT DISTINCT lang, source FROM docs
    ), langs AS (
        SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
    ), totals AS (
        SELECT lang, source, coalesce((SELECT sum(n) FROM uses u WHERE u.lang = g.lang AND u.source = g.source), 0) AS total FROM groups g
    ), shares AS (
        SELECT lang, t.source, k.term, coalesce(n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
               1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
        FROM totals t JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN uses u USING (lang, source, term)
    ), pairs AS (
        SELECT g.lang, g.source, h.source AS item,
               coalesce((SELECT sum(abs(a.p - b.p)) FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term
                         WHERE a.lang = g.lang AND a.source = g.source AND b.source = h.source), 0) AS value
        FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    ), parts AS (
        SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
        UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 50"""


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # Digests are taken where the ids lie, so that those are not shuffled.
    return best_fit.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_html_text, op2_language, op3_warc, op4_token_files, op5_repetition, op6_packing, op7_order_minhash, op8_mixing, op9_simhash, op10_chat,
        op11_hard_negatives, op12_divergence, op13_best_fit,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op10_chat": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_divergence": OP12_SQL}
