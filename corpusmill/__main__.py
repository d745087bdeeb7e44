"""Command line: ``python -m corpusmill`` list, run, sql, build, clean, split, pack, pack-sft or shuffle."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_rows, code_points
from corpusmill.operators import chat, intervals, rows, sft
from corpusmill.plans import catalogue
from corpusmill.session import build_session
from corpusmill.sources import readers, sinks
from corpusmill.sql import register_views

_READERS = {"json": readers.read_json_arrays, "jsonl": readers.read_jsonl_text, "lines": readers.read_lines, "parquet": readers.read_parquet_text}


def _arguments(words: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query")
    sql = commands.add_parser("sql", help="a SQL statement over a folder of tables")
    sql.add_argument("statement")
    for command in (run, sql):
        command.add_argument("tables")
        command.add_argument("--out", help="a folder for Parquet; without it the first rows are shown")
        command.add_argument("--rows", type=int, default=20)
    build = commands.add_parser("build", help="texts of JSONL, JSON array, line or Parquet files as chunks")
    build.add_argument("kind", choices=sorted(_READERS))
    build.add_argument("--chunk-size", type=int, default=2000)
    sft_ = commands.add_parser("pack-sft", help="chat records (JSONL) as blocks of code points, with weights and spans of answers")
    sft_.add_argument("--block-size", type=int, default=2048)
    sft_.add_argument("--val-ratio", type=float, default=0.0)
    sft_.add_argument("--think-loss-weight", type=float, default=0.1)
    sft_.add_argument("--think-boundary-loss-weight", type=float, default=1.0)
    for command in (build, sft_):
        command.add_argument("source")
        command.add_argument("out")
        command.add_argument("--limit", type=int, help="the first records only: of each file for build, of all for pack-sft")
        command.add_argument("--overwrite", action="store_true")
        command.add_argument("--seed", type=int, default=1337)
    for name, text in (("clean", "clean texts, drop bad ones and copies"), ("split", "training and validation texts"), ("pack", "texts as blocks of code points"), ("shuffle", "rows in a seeded random order")):
        command = commands.add_parser(name, help=text)
        command.add_argument("source")
        command.add_argument("out")
        command.add_argument("--limit", type=int, help="the first rows of each file only")
        command.add_argument("--overwrite", action="store_true")
        command.add_argument("--seed", type=int, default=42)
        if name == "split":
            command.add_argument("--val-ratio", type=float, default=0.01)
        if name == "pack":
            command.add_argument("--block-size", type=int, default=2048)
    return parser.parse_args(words)


def _built(a: argparse.Namespace, spark: SparkSession) -> None:
    """Each source's texts end to end, in chunks; those of JSON arrays are named by the records that complete them."""
    found = _READERS[a.kind](spark, a.source)
    if a.limit is not None:
        found = rows.limit_by_source(found, a.limit)
    if a.kind == "json":
        chunks = intervals.chunk_records(found, a.chunk_size, whole="whole")
    else:
        chunks = intervals.chunk_texts(found, a.chunk_size)
    sinks.write_text(chunks, a.out, a.overwrite)


def _packed_sft(a: argparse.Namespace, spark: SparkSession) -> None:
    """Records in a seeded order, split, encoded and packed into out/train and out/val."""
    records = readers.read_chat_jsonl(spark, a.source, a.limit)
    kept = records.where(chat.storage_error(chat.normalize(F.col("messages"))).isNull())
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(a.seed), "_path", "at"), 33).cast("long")
    drawn = kept.select(draw.alias("draw"), "_path", "at", chat.normalize(F.col("messages")).alias("messages"))
    same = F.row_number().over(Window.partitionBy("draw").orderBy("_path", "at")) - 1  # a few rows share a draw
    placed = sinks.written(drawn.withColumn("same", same), "chats")
    first = placed.groupBy("draw").agg(F.count("*").alias("rows"))
    starts = intervals.with_offsets(first, F.col("rows"), "draw", name="start").select("draw", "start")
    numbered = sinks.written(placed.join(starts, "draw").select((F.col("start") + F.col("same")).alias("row_idx"), "messages"), "chats")
    parts = rows.sft_split(numbered, "row_idx", a.val_ratio)
    for name, part in (("train", parts.where("not is_val")), ("val", parts.where("is_val"))):
        if name == "val" and not a.val_ratio:
            continue
        encoded = chat.encode_sft(F.col("messages"), a.think_loss_weight, a.think_boundary_loss_weight)
        packed = sft.pack_sft(part.select("row_idx", encoded.alias("e")), a.block_size)
        sinks.write_packed(packed, f"{a.out}/{name}", a.block_size, a.overwrite, form="packed-sft-v1", seed=a.seed)


def _prepared(a: argparse.Namespace, texts: DataFrame) -> DataFrame:
    if a.command == "clean":
        return rows.dedup_first(clean_rows(texts), order=("source", "row_idx")).select("text", "source")
    if a.command == "split":
        at = texts.withColumn("at", F.concat_ws("/", "source", F.lpad(F.col("row_idx").cast("string"), 20, "0")))
        return rows.split_by_hash(at, "at", a.val_ratio, a.seed).select("text", "source", "is_val")
    return rows.shuffle_rows(texts, a.seed, a.source)


def main(words: list[str] | None = None) -> None:
    a = _arguments(words)
    if a.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    spark = build_session()
    if a.command in ("run", "sql"):
        if a.command == "sql":
            register_views(spark, a.tables)
        found = catalogue.QUERIES[a.query](spark, a.tables) if a.command == "run" else spark.sql(a.statement)
        found.write.mode("errorifexists").parquet(a.out) if a.out else found.show(a.rows, truncate=60)
        return
    if a.command in ("build", "pack-sft"):
        return _built(a, spark) if a.command == "build" else _packed_sft(a, spark)
    texts = readers.read_parquet_text(spark, a.source)
    texts = texts if a.limit is None else rows.limit_by_source(texts, a.limit)
    if a.command == "pack":
        ids = texts.select("row_idx", F.concat(code_points(F.col("text")), F.array(F.lit(1))).alias("tokens"))
        sinks.write_packed(intervals.pack_tokens(ids, a.block_size), a.out, a.block_size, a.overwrite)
        return
    _prepared(a, texts).write.mode("overwrite" if a.overwrite else "errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()
