"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm._frames import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n_source FROM documents GROUP BY 1),
rates AS (
  SELECT s, sqrt(n_source) / (SELECT sum(sqrt(n_source)) FROM n) * (SELECT sum(n_source) FROM n) / n_source AS rate FROM n
),
cdf AS (
  SELECT s, rate, 0 AS k, 0.0::DOUBLE AS log_fact, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT s, rate, k + 1, log_fact + ln(k + 1), cdf + exp((k + 1) * ln(rate) - rate - (log_fact + ln(k + 1)))
  FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)
),
tables AS (SELECT s, list(cdf ORDER BY k) AS cdf FROM cdf GROUP BY s),
counted AS (
  SELECT d.*, len(list_filter(t.cdf, lambda c: c < (('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS n
  FROM documents d JOIN tables t ON coalesce(d.source, '') = t.s
),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INT AS mix_copy FROM counted)
SELECT *, md5('order|17|' || doc_id || '|' || mix_copy) AS mix_order FROM copies
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.sharding import shard_bytes

    return shard_bytes(read_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.substring_dedup import substring_dedup

    found = substring_dedup(read_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


#: Where the public tokenizers' vocabulary files lie on the driver; only their bytes are shipped.
TOKENIZERS = os.environ.get("CIPHERLAKE_TOKENIZERS", "/opt/tokenizers")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.secrets import scan_secrets, span_digest

    return span_digest(scan_secrets(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.toxicity import score_toxicity, train

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_words",
        F.round("toxic_words", 6).alias("toxic_words"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("toxic_spans"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm._frames import Workspace
    from cipherlake.llm.media import feature_digest, media_files, read_tensors, tensor_batches

    ws, docs = Workspace(spark, "media"), read_table(spark, sf_dir, "documents")
    files = ws.save(media_files(docs), "files")
    tensors = ws.save(tensor_batches(files), "tensors")
    return feature_digest(read_tensors(tensors, dict(docs.dtypes)["doc_id"]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.sentencepieces import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm._frames import Workspace
    from cipherlake.llm.warc import assemble, capture_summary, read_warc, write_warc

    ws = Workspace(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), ws.path("archives"))
    return capture_summary(assemble(read_warc(spark, ws.path("archives"))))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
d AS (SELECT *, unhex(sha1(html)) AS digest FROM p),
bits AS (SELECT *, octet_length(encode(html)) AS n FROM d)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(sha1(html) || '0', 1 + (i * 5) // 4, 3))::BIGINT) >> (12 - 5 - (i * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to,
  regexp_replace(url, '[\x00-\x20]', '', 'g') AS target_uri, true AS has_request
FROM bits
"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.jaccard_join import jaccard_join

    return jaccard_join(read_table(spark, sf_dir, "documents"), width=5, percent=80)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlake.llm.conversation_trie import conversation_trie

    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_sentencepiece, op3_warc, op4_suffix_array_dedup, op5_minhash_near_dedup, op6_secret_scan, op7_mixing, op8_toxicity, op9_media, op10_sharding,
        op11_jaccard_join, op12_spelling_variants, op13_conversation_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op7_mixing": OP7_SQL}
