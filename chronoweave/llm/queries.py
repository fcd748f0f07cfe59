"""The operators over the driver's tables, and SQL for the same results where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_passages
from .html_text import extract_text
from .language import fit_languages, identify_languages
from .language_model import score_corpus
from .mixing import mix_sources
from .near_dedup import simhash_components
from .pii import pii_digest
from .quality_model import fit_quality, score_quality
from .quality_rules import STOP_WORDS, quality_rules
from .shared import shared_dir
from .splits import remainder
from .warc import write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(_table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return archive.records(payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    score = F.col("_quality_score")
    return score_quality(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_model": op2_language_model,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_model": op8_quality_model,
    "op9_html_text": op9_html_text,
    "op10_pii": op10_pii,
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), seen AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS n FROM win
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM seen, (SELECT unnest(range(0, 5)) AS k) WHERE seen.n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(regexp_extract_all(t, '!')) AS n_exclaim,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter
  FROM w LEFT JOIN covered c USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN n_words = 0 THEN false ELSE
    n_words >= 10 AND CAST(n_repeat_words AS DOUBLE) / n_words <= 0.2
    AND CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.5 AND 12.0
    AND CAST(n_symbols AS DOUBLE) / n_words <= 0.1 AND CAST(n_exclaim AS DOUBLE) / n_words <= 0.2
    AND CAST(n_upper AS DOUBLE) / word_chars <= 0.4 AND CAST(n_letter AS DOUBLE) / n_words >= 0.6
    AND (n_words < 20 OR CAST(n_stop AS DOUBLE) / n_words >= 0.03)
    AND CAST(n_distinct AS DOUBLE) / n_words >= 0.35
    AND (n_words < 20 OR CAST(n_dup_lines AS DOUBLE) / n_lines <= 0.6) END AS kept
FROM f
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS size, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS main FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM q)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM main THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM main THEN main END AS refers_to
FROM v
""",
    "op6_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT *, len(w) AS n, least(len(w), 5) AS k FROM b WHERE len(w) > 0
), bp AS (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i
), bs AS (SELECT bid, n, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM bp
), ic AS (SELECT bid, n, k, s, count(*) AS c FROM bs GROUP BY ALL
), dp AS (SELECT rid, w, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) ks WHERE len(w) >= ks.k
), ds AS (SELECT rid, len(w) AS total, k, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS s FROM dp
), hit AS (SELECT rid, total, p, ic.bid, ic.n, ic.k, ic.s, ic.c, least(ic.n, total) - ic.k + 1 AS m FROM ds JOIN ic ON ds.k = ic.k AND ds.s = ic.s
), win AS (SELECT *, unnest(range(greatest(0, p - m + 1), least(p, greatest(0, total - n)) + 1)) AS start FROM hit
), cm AS (SELECT rid, bid, n, k, m, start, s, least(count(*), c) AS shared FROM win GROUP BY rid, bid, n, k, m, start, s, c
), m AS (SELECT rid, bid, start, CAST(sum(shared) AS DOUBLE) AS common, m + n - k + 1 AS total FROM cm GROUP BY rid, bid, n, k, m, start
), r AS (SELECT DISTINCT d.doc_id, i.item_id, m.start, common / (m.total - common) AS similarity FROM m JOIN d ON d.rid = m.rid JOIN i ON i.bid = m.bid
)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, [-similarity, start]) AS BIGINT) AS start, count(*) AS n_windows FROM r WHERE similarity >= 0.8::DOUBLE GROUP BY doc_id, item_id
""",
    "op7_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * weight < cap), 'inf'::DOUBLE) * weight) AS target FROM l
), p AS (
  SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM p
""",
}
