"""Queries that run streams over files of driver tables, several micro-batches each, with DuckDB SQL that works on the tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.intervals import with_offsets
from corpusmill.plans import sequence_queries
from corpusmill.plans.text_queries import CLEAN_CTE, documents
from corpusmill.sources import sinks
from corpusmill.streaming import feeds

BLOCK, SHARDS, BATCHES, ROWS = 512, 3, 4, 4096


def _files(df: DataFrame, key: str, name: str, form: str = "parquet") -> tuple[str, int]:
    """(path, files a batch): df in files of about ROWS rows, dealt by a hash of their key, so that each file has rows from all over the table; BATCHES batches take them all."""
    spark, path = df.sparkSession, sinks.scratch_path(df.sparkSession, name)
    each = max(1, -(-df.select(key).count() // (BATCHES * ROWS)))
    n = BATCHES * each
    dealt = df.repartitionById(n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).write.format(form)
    with feeds.shuffles_removed(spark):
        (dealt.option("compression", "zstd") if form == "parquet" else dealt).save(path)
    return path, each


def _run(stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    spark = stream.sparkSession
    return feeds.run_available(stream, sinks.scratch_path(spark, name), sinks.scratch_path(spark, f"{name}-state"), partitions)[0]


def _read(spark: SparkSession, found: tuple[str, int], schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", found[1]).parquet(found[0])


def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose rows arrive out of order, packed by shards in the order of their numbers."""
    ended = F.when(F.col("text") != "", F.concat(F.make_valid_utf8(F.col("text")), F.lit("\x01")))
    rows = with_offsets(documents(spark, sf_dir), F.lit(1), "doc_id", name="row_idx", bucket=512).select("row_idx", "text")
    stream = _read(spark, _files(rows, "row_idx", "stream-tokens"), "row_idx long, text string").select("row_idx", ended.alias("tokens"))
    packed = _run(feeds.pack_feed(stream, BLOCK, SHARDS), "stream-packed")
    return packed.select("shard", "window", sequence_queries._weighed(F.col("token_ids")).alias("tokens"))


STREAM_PACK = f"""
WITH docs AS (SELECT n, string_split(text, '') AS chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE text <> ''),
toks AS (SELECT n, i - 1 AS pos, CASE WHEN i <= len(chars) THEN unicode(chars[i]) ELSE 1 END AS tok FROM docs, unnest(range(1, len(chars) + 2)) AS u(i)),
stream AS (SELECT n % {SHARDS} AS shard, tok, row_number() OVER s - 1 AS g, count(*) OVER (PARTITION BY n % {SHARDS}) AS total FROM toks WINDOW s AS (PARTITION BY n % {SHARDS} ORDER BY n, pos)),
windows AS (
  SELECT shard, k, g - k * {BLOCK} AS j, tok, total FROM (
    SELECT *, g // {BLOCK} AS k FROM stream UNION ALL SELECT *, g // {BLOCK} - 1 AS k FROM stream WHERE g % {BLOCK} = 0 AND g > 0))
SELECT shard, k AS "window", sum(tok * (j + 1))::BIGINT AS tokens FROM windows WHERE k < (total - 1) // {BLOCK} GROUP BY shard, k"""


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned and gated as they arrive, each text once; their times lie within the watermark."""
    d = documents(spark, sf_dir).select("doc_id", "text", "source", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("doc_id", F.lit(3600))).alias("ts"))
    files = _files(d, "doc_id", "stream-texts")
    stream = _read(spark, files, "doc_id long, text string, source string, ts timestamp")
    return _run(feeds.clean_feed(stream.drop("doc_id"), "2 hours"), "stream-cleaned", files[1]).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"))


STREAM_DEDUP = f"WITH {CLEAN_CTE} SELECT DISTINCT md5(text) AS digest, 1::BIGINT AS copies FROM gated WHERE reason IS NULL"


def stream_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with thinking that arrive as JSON lines, as they are stored."""
    path, each = _files(sequence_queries.with_think(spark, sf_dir), "conv_id", "stream-chats", "json")
    stored = _run(feeds.chat_feed(spark, path, extra="conv_id long", files_a_batch=each), "stream-stored")
    return stored.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest"))


STREAM_CHAT = f"SELECT conv_id, digest FROM ({sequence_queries.CHAT_STRIP_THINK}) WHERE error IS NULL"

QUERIES = {"stream_pack": stream_pack, "stream_dedup": stream_dedup, "stream_chat": stream_chat}
ORACLES = {"stream_pack": STREAM_PACK, "stream_dedup": STREAM_DEDUP, "stream_chat": STREAM_CHAT}
