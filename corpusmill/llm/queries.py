"""One query for each training-data operator, over its whole table, and SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import fim, html_text, mixing, packing, pieces, quality, secrets, simhash, token_files, url_filter, vector_dedup, whitening
from corpusmill.llm import suffix_dedup as suffixes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.suffix_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_groups(_read(spark, sf_dir, "embeddings"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), WORD_VOCABULARY, "words", END_ID)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(_read(spark, sf_dir, "documents"), PIECE_MODEL)
    return pieces.decode_pieces(encoded, PIECE_MODEL).select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), BYTE_VOCABULARY, "spaced", END_ID).drop("ids")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BAD_SITES = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, BAD_SITES))).alias("key"))
    return url_filter.url_filter(_read(spark, sf_dir, "pages"), listed)


OP8_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) IN ({", ".join(f"'{x}'" for x in BAD_SITES)}) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.secret_model(docs))
    counts = [secrets.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", *counts, F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _repeated(name: str, size: int) -> str:
    """Words of each document that lie in a string of ``size`` words found twice in it."""
    return f"""
{name}_at AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM texts, unnest(range(1, len(w) - {size - 2})) AS u(i)),
{name} AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS copies FROM {name}_at), unnest(range(0, {size})) AS v(k)
  WHERE copies > 1 GROUP BY doc_id)"""


_LIMITS = quality.Limits()
OP10_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
{_repeated("window_words", _LIMITS.window)},
{_repeated("repeat_words", _LIMITS.repeat)},
{_repeated("long_words", _LIMITS.longest + 1)},
counts AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(window_words.n, 0) AS n_repeat_words,
    coalesce(repeat_words.n, 0) AS covered, coalesce(long_words.n, 0) AS long_repeats
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN window_words USING (doc_id) LEFT JOIN repeat_words USING (doc_id) LEFT JOIN long_words USING (doc_id)),
judged AS (SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.window_percent} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * covered <= {_LIMITS.covered_percent} * n_words AND long_repeats = 0 AS kept
FROM judged
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_files": op4_token_files,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scans": op9_secret_scans,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixing": op12_source_mixing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op8_url_filter": OP8_SQL, "op10_quality_rules": OP10_SQL}
