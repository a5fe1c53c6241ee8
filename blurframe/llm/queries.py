"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, language, mixing, passages, quality, simhash, token_counts, token_files, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_mixture": op1_language_mixture,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_html_region": op4_html_region,
    "op5_token_files": op5_token_files,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_host_quality": op8_host_quality,
    "op9_compact_windows": op9_compact_windows,
    "op10_mix_sources": op10_mix_sources,
}

_WORD = r"[^\x20\x09-\x0D]+"

def _host_sql(rule: str) -> str:
    """Lower bound of a host's shrunk failure rate of one rule; ``p`` has the moments of all hosts."""
    mean = f"least(greatest(m_{rule}, 1e-6), 1 - 1e-6)"
    noise = f"({mean} * (1 - {mean}))"
    between = f"((q_{rule} - docs * {mean} * {mean} - (hosts - 1) * {noise}) / docs)"
    strength = f"(CASE WHEN {between} > 0 THEN least(greatest({noise} / {between} - 1, 2.0), 1000.0) ELSE 1000.0 END)"
    rate = f"((h.{rule} + {mean} * {strength}) / (n + {strength}))"
    return f"{rate} - 3.0 * sqrt({rate} * (1 - {rate}) / (n + {strength} + 1))"


SQL: dict[str, str] = {
    "op6_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, (coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_mix_sources": rf"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM s GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS over_weight,
    row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS rank
  FROM w WINDOW earlier AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, bool_and(cap * over_weight <= remaining * weight) OVER (ORDER BY rank) AS capped FROM o
), f AS (
  SELECT remaining, over_weight FROM c WHERE NOT capped ORDER BY rank LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (CAST((SELECT remaining FROM f) AS DOUBLE) / CAST((SELECT over_weight FROM f) AS DOUBLE)) END AS target FROM c
), p AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - earlier)) AS BIGINT) AS taken
FROM p
""",
    "op8_host_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), c AS (
  SELECT row, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d
), l AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY row
), win AS (
  SELECT row, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT row, unnest(range(i, i + 8)) AS p FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS times FROM win) WHERE times > 1
  ) GROUP BY row
), m AS (
  SELECT c.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN l USING (row) LEFT JOIN rep USING (row)
), r AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeat, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(CAST({r} AS INTEGER)) AS DOUBLE) AS {r}" for r in quality.RULES)} FROM r GROUP BY source
), p AS (
  SELECT sum(n) AS docs, count(*) AS hosts, {", ".join(f"sum({r}) / sum(n) AS m_{r}, sum({r} * {r} / n) AS q_{r}" for r in quality.RULES)} FROM h
), v AS (
  SELECT source, {" OR ".join(f"{_host_sql(r)} > 0.5" for r in quality.RULES)} AS bad FROM h CROSS JOIN p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeat) AS base_failed, NOT (short OR repeat) AND NOT bad AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
""",
}
