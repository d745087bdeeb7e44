"""Queries over tables of several files: shuffled tables, shards, footers and buffered shuffles, each with DuckDB SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import rows
from corpusmill.plans import sequence_queries
from corpusmill.plans.text_queries import SEED, SHUFFLE, documents
from corpusmill.sources import files, sinks

SHARDS, BUFFER = 5, 64


def shuffle_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in a shuffled order, and the place of each in the files."""
    path = sinks.scratch_path(spark, "shuffled")
    files.write_shuffled(documents(spark, sf_dir), path, SEED, "documents.parquet", "doc_id")
    return files.with_row_numbers(spark, path, ("doc_id",), "position")


SHUFFLE_WRITTEN = f"WITH k AS ({SHUFFLE}) SELECT row_number() OVER (ORDER BY key) - 1 AS position, doc_id FROM k"


def _in_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Documents in the order of their ids, in seven files."""
    path = sinks.scratch_path(spark, name)
    documents(spark, sf_dir).select("doc_id", "text").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return path


def shards_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = files.with_row_numbers(spark, _in_files(spark, sf_dir, "shards"))
    shards = [rows.shard(numbered, SHARDS, i).select(F.lit(i).cast("long").alias("shard"), "row_idx", "doc_id", F.md5("text").alias("digest")) for i in range(SHARDS)]
    out = shards[0]
    for shard in shards[1:]:
        out = out.union(shard)
    return out


SHARDS_OF_FILES = f"SELECT n % {SHARDS} AS shard, n AS row_idx, doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)"


def buffered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard after a shuffle through a buffer: their places are all different, and none comes out before the buffer was full."""
    numbered = files.with_row_numbers(spark, _in_files(spark, sf_dir, "buffered"), ("doc_id",))
    placed = rows.buffered_order(numbered, SHARDS, SEED, epoch=1, buffer=BUFFER)
    early = F.floor(F.col("row_idx") / SHARDS) - F.col("place")
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), (F.max(early) < BUFFER).alias("held_back"), (F.sum(F.abs(early)) > 0).alias("moved"))


BUFFERED_SHARDS = f"SELECT n % {SHARDS} AS shard, count(*) AS n, count(*) AS places, count(*) - 1 AS last, true AS held_back, true AS moved FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY 1"


def footer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the footers of packed rows in four groups say of their block size. A group is as many files as tasks had rows of it, whose footers' counts add up."""
    path = sinks.scratch_path(spark, "footers")
    sinks.write_packed(sequence_queries.packed(spark, sf_dir).withColumn("group", F.pmod("window", F.lit(4))), path, sequence_queries.BLOCK, by=("group",))
    found = files.footer_values(spark, path).where("key in ('block_size', 'format')")
    return found.groupBy(F.regexp_extract("folder", r"^group=(\d+)$", 1).cast("long").alias("file"), "key", "value").agg(F.sum("n_rows").alias("n_rows"))


FOOTER_VALUES = f"""
WITH t AS (SELECT sum(length(text) + 1) AS total FROM documents WHERE text <> ''), w AS (SELECT unnest(range(0, ((total - 1) // {sequence_queries.BLOCK})::BIGINT)) AS w FROM t),
f AS (SELECT w % 4 AS file, count(*) AS n_rows FROM w GROUP BY 1)
SELECT file, n_rows, key, value FROM f, (VALUES ('block_size', '{sequence_queries.BLOCK}'), ('format', 'packed-v1')) v(key, value)"""

QUERIES = {"shuffle_written": shuffle_written, "shards_of_files": shards_of_files, "buffered_shards": buffered_shards, "footer_values": footer_values}
ORACLES = {"shuffle_written": SHUFFLE_WRITTEN, "shards_of_files": SHARDS_OF_FILES, "buffered_shards": BUFFERED_SHARDS, "footer_values": FOOTER_VALUES}
