"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import license_scan, line_dedup, mixing, near_dedup, packing, quality_rules, sharding, suffix_dedup, token_files, topk
from chronolith.llm._common import table

SHARDS = 40


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_packing, op4_sharding, op5_line_dedup, op6_mixing, op7_near_dedup, op8_exact_topk, op9_suffix_dedup, op10_token_files)}

_TEMPLATE_ROWS = ",\n        ".join(f"('{label}', {license_scan.template_words(wording)!r})" for label, wording in license_scan.TEMPLATES)

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": rf"""
    WITH templates(label, words) AS (VALUES
        {_TEMPLATE_ROWS}
    ), docs AS (
        SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), worded AS (
        SELECT r, doc_id, t, regexp_extract_all(t, '{license_scan.WORD}') AS w FROM docs
    ), ends AS (
        SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM worded
    ), places AS (
        SELECT r, CASE WHEN w[i - 1] IN ('mit', 'apache') THEN i - 2 ELSE i - 3 END AS start,
               CASE WHEN w[i - 1] IN ('mit', 'apache') THEN w[i - 1] ELSE 'gpl' END AS label
        FROM ends WHERE w[i] = 'license' AND i > 1 AND (w[i - 1] IN ('mit', 'apache') OR (i > 2 AND w[i - 1] = 'public' AND w[i - 2] = 'general'))
    ), base AS (
        SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY r
    ), lined AS (
        SELECT r, list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, '{license_scan.WORD}')) AS l FROM docs
    ), blocks AS (
        SELECT r, list_distinct(list_concat(l[i], flatten(l[i + 1:i + {license_scan.LINES}])[1:{license_scan.reach()}])) AS b FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM lined)
    ), found AS (
        SELECT r, label, len(list_intersect(b, words)) / len(words) AS score FROM blocks JOIN templates ON len(b) > 0 AND len(list_intersect(b, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9)
    ), labelled AS (
        SELECT r, label, true AS is_base FROM places UNION ALL SELECT r, label, false FROM found
    ), named AS (
        SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels FROM labelled GROUP BY r
    ), scores AS (SELECT r, max(score) AS score FROM found GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM worded LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN scores USING (r)
    """,
    "op6_mixing": rf"""
    WITH docs AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size, length(coalesce(text, '')) AS chars FROM documents
    ), keyed AS (
        SELECT row_number() OVER () AS r, doc_id, source, size,
               -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|17'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) * (1 + abs(chars / greatest(size, 1) - 6.5) / 6.5) AS key FROM docs
    ), sizes AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
    ), weighed AS (
        SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM sizes
    ), levels AS (
        SELECT *, 3 * source_size / w AS ratio, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level
        FROM weighed WINDOW q AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), aimed AS (
        SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(3 * source_size AS DOUBLE) ELSE w * max(level) FILTER (WHERE ratio > level) OVER () END AS target FROM levels
    ), planned AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS epochs,
               greatest(CAST(floor(target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END * source_size) AS BIGINT), 0) AS rest FROM aimed
    ), running AS (
        SELECT k.*, source_size, target, epochs, rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
    ), first AS (
        SELECT *, rest > 0 AND upto <= rest AS inside, rest - coalesce(sum(size) FILTER (WHERE upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM running
    ), filled AS (
        SELECT *, row_number() OVER (PARTITION BY source, NOT inside AND rest > 0 AND size > 0 AND size <= gap ORDER BY size DESC, key, doc_id, r) = 1 AND NOT inside AND rest > 0 AND size > 0 AND size <= gap AS fill FROM first
    )
    SELECT doc_id, source, size, source_size, target, CAST(epochs + CASE WHEN inside OR fill THEN 1 ELSE 0 END AS BIGINT) AS repeats, CAST((epochs + CASE WHEN inside OR fill THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM filled
    """,
    "op8_exact_topk": """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
    SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id AS vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) QUALIFY rank <= 20
    """,
}
