"""The training-data pipeline: five operators in turn over the documents table.

Each stage gets what its predecessor wrote and returns the columns of documents, but for the
last, which returns the packed pieces. Rejected documents and near copies go; repeated
passages and secrets leave the texts. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import packing, quality, secrets, simhash, suffix_dedup
from corpusmill.llm.common import free_name, remove, shared_path, written

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SIMILARITY = 0.8


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and the number of its characters where there is a column for it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts go."""
    return quality.quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word strings, that with the smallest doc_id."""
    return simhash.similar_keep_first(docs, SIMILARITY)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that earlier documents hold; documents of which nothing but white space is left go."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    # smaller blocks and buckets than alone: workers of the stages before still hold memory
    found = suffix_dedup.suffix_dedup(docs.select("doc_id", "text", own.alias("_columns")), carry=("_columns",), characters=True, block_bytes=2 << 20, bucket_bytes=2 << 20)
    left = found.where((F.col("n_removed") == 0) | F.col("kept").cast("string").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left.select("_columns.*", F.col("kept").cast("string").alias("text")), F.col("text")).select(*_columns(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret; other columns, whatever their names, stay."""
    spans = free_name(docs, "spans")
    found = secrets.find_secrets(docs, secrets.secret_model(docs), spans)
    return _with_text(found, secrets.redacted(F.col("text"), F.col(f"`{spans}`"))).select(*_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    return packing.best_fit_packing(docs, BYTE_VOCABULARY, "spaced", END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express fingerprints, byte spans, character models and tokens; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder and read again.

    A stage's folders go once its result is written, and that result once the next stage has
    read it; the pieces that the last result reads stay until ``clean_up``. An empty table gives
    an empty result. Null ids and repeated rows pass through the stages as each of these states.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        own, before = written(), path
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for old in (written() - own - {path}) | ({before} if before else set()):
            remove(spark, old)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, path)
    return packed
