"""The operators' queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import decontaminate, exact_dedup, html_extract, mixing, near_dedup, pseudonyms, quality, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), pseudonyms.DEMO_KEY)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_source_mixing": op3_source_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_pseudonyms": op8_pseudonyms,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op3_source_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 14) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level,
         CAST(3 * source_size AS DOUBLE) / weight AS ratio
  FROM ranked
  WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firsts AS (SELECT ratio AS fr, rank AS frank, level AS flevel FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN flevel IS NULL OR ratio < fr OR (ratio = fr AND rank < frank) THEN CAST(3 * source_size AS DOUBLE) ELSE flevel * weight END AS target
  FROM levels LEFT JOIN firsts ON true),
queued AS (
  SELECT doc_id, size, h, b.source, source_size, rank, target, epoch,
         CASE WHEN target > 0 THEN CAST(epoch * source_size + sum(size) OVER (PARTITION BY rank, epoch ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target ELSE 0.0 END AS finish
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source, range(3) e(epoch)
  WHERE epoch < greatest(1, least(3, ceil(target / greatest(source_size, 1))))),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM queued)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= (SELECT sum(source_size) FROM sizes) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM run GROUP BY doc_id, size, source_size, target
""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS p, h FROM d WHERE n >= 100),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY substr(h, 2 * p + 1, 200) ORDER BY doc_id, p) AS turn FROM w),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE turn > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
r AS (SELECT k.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(kept || substr(h, 2 * last_end + 1), h))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY body)
""",
}
