"""The registered queries of the corpus operators and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole
table and derives the columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, exact, langid, mixing, neardup, substring, suffixes, tokens, urls, warc
from tessera.llm.common import working_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.is_held_out()))
    found = docs.select("doc_id", langid.is_held_out().alias("held_out"), langid.identify(docs, model).alias("found"))
    # The contract names a learned language wherever there is a letter; rejection is a column of its own.
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeated_words(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), tokens.token_counts(F.col("text"), vocabulary_path()).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# The listed rules of the contract as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence", "mined_rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_manifest(manifest, folder))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
}

SQL = {
    "op2_suffix_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT k, b, substr(x, 2 * b + 1, 1422) AS part FROM d, unnest(range(0, length(x) // 2, 512)) t(b)
), w AS MATERIALIZED (
  SELECT k, b + i AS i, md5(substr(part, 2 * i - 1, 400)) AS g FROM p, unnest(range(1, least(512, length(part) // 2 - 199) + 1)) u(i)
), r AS (
  SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)
), n AS (
  SELECT k, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS span FROM r
), s AS (
  SELECT k, min(i) AS a, max(i) + 199 AS b FROM n GROUP BY k, span
), g AS (
  SELECT s.k, a, b, coalesce(lag(b) OVER (PARTITION BY s.k ORDER BY a), 0) AS before FROM s
), o AS (
  SELECT d.k, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM g JOIN d ON g.k = d.k GROUP BY 1
)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN o ON d.k = o.k
""",
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, i, word FROM (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)
), n AS (
  SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS size FROM w
), r AS (
  SELECT *, CASE WHEN size = 35 AND count(*) OVER (PARTITION BY size, run) > 1 THEN 1 ELSE 0 END AS again FROM n
), f AS (
  SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r
), g AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
""",
    "op9_exact_dedup": r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM m
""",
}
