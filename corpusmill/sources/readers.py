"""Readers of text, JSON and Parquet corpora into rows (text, source, row_idx), and of packed shards.

All of them are Spark scans: they read any store that Spark reads, and nothing is sniffed by
opening files on the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators.checks import SFT_COLUMNS, sft_sample
from corpusmill.operators.intervals import with_offsets
from corpusmill.operators.rows import buffered_order
from corpusmill.sources.files import footer_values, with_row_numbers
from corpusmill.sources.json_arrays import array_objects
from corpusmill.sources.render import translation

_FILE = "_metadata.file_name"


def _placed(df: DataFrame) -> DataFrame:
    """df, a scan of files, with its rows' file, path and split."""
    return df.withColumns({"source": F.col(_FILE), "_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def _numbered(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows of a scan (``_placed``, then filtered and joined with broadcast tables only) numbered from 0 in each file.

    A task reads its splits in order, so ids of the rows that are left ascend by one inside a
    split. A row's number is its id less the split's first, and the rows of the file's splits
    before: the rows themselves are neither moved nor sorted, however large a file is.
    """
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("_path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    # a row for each split of the files, whose list the driver holds anyway
    return rows.join(F.broadcast(bases), ["_path", "_block"]).withColumn(name, F.col("_base") + F.col("_at")).drop("_at", "_base")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name and bytes of the files below a folder, by path, hidden ones left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.col("length").alias("n_bytes")).where(~F.col("name").startswith(".")).orderBy("path")


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt", replace: bool = False) -> DataFrame:
    """One row for each whole file: UTF-8, or GB18030 where it isn't; with ``replace`` wrong bytes become U+FFFD instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    as_text = F.col("content").cast("string")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        text = F.make_valid_utf8(as_text) if replace else F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode("content", "GB18030"))
        out = files.select(text.alias("text"), F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(0).cast("long").alias("row_idx"))
        out.schema  # noqa: B018  analysed here
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", before)
    return out


def line_rows(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(_path, _block, source, row_idx, line): every line of the files at path, numbered from 0 in each file. Files are split like any Spark text scan, and lines aren't shuffled."""
    lines = _placed(spark.read.option("recursiveFileLookup", recursive).text(path)).select("_path", "_block", "source", F.col("value").alias("line"))
    return _numbered(lines)


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row for each line that isn't empty; row_idx counts empty ones too, and so does ``limit`` for each file."""
    rows = line_rows(spark, path).where("line <> ''")
    return (rows if limit is None else rows.where(F.col("row_idx") < limit)).select(F.col("line").alias("text"), "source", "row_idx")


def read_parquet_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a Parquet table by its columns: TEXT, a pair of original and translation, text, or en and ch; others raise ValueError."""
    df = spark.read.parquet(path)
    names = df.columns
    rows, own = _placed(df), ("source", "_path", "_block")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    if "TEXT" in names:
        kept = rows.select(filled("TEXT").alias("text"), *own)
    elif {"og_full_text", "translated_text"} <= set(names):
        pairs = _numbered(rows.where(filled("og_full_text").isNotNull() | filled("translated_text").isNotNull()))
        zh, en = filled("translated_text"), filled("og_full_text")
        kept = pairs.select(F.when(zh.isNotNull() & en.isNotNull(), translation(zh, en, F.col("row_idx"))).otherwise(F.coalesce(zh, en)).alias("text"), "source", "row_idx")
    elif "text" in names:
        kept = rows.select(filled("text").alias("text"), *own)
    elif {"en", "ch"} <= set(names):
        pairs = _numbered(rows.where("en is not null and ch is not null"))
        kept = pairs.select(translation(F.col("ch"), F.col("en"), F.col("row_idx")).alias("text"), "source", "row_idx")
    else:
        raise ValueError(f"no known text column among {names}")
    kept = kept.where("text is not null")
    return (kept if "row_idx" in kept.columns else _numbered(kept)).select("text", "source", "row_idx")


_RECORD = "zh_text string, en_text string, `段落` array<struct<`内容`:string>>, `主题` string, `回复` array<struct<`回复`:string>>, instruction string, input string, output string, `问` string, `答` string, ID string, completion string, query string, thought string, text string, content string, source string"


def _jsonl_kind(record: Column) -> Column:
    has = lambda k: F.array_contains(F.json_object_keys(record), k)
    return F.when(has("zh_text"), "translation").when(has("段落") & ~has("ID"), "segments").when(has("回复"), "forum").when(has("instruction"), "instruction").when(has("问"), "wikihow")


def read_jsonl_text(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Texts of JSONL files of five kinds, each file's kind taken from its first line that isn't blank.

    Blank and malformed lines and non-objects are skipped, and files of another kind as a whole.
    ``limit`` keeps the first accepted records of each file.
    """
    lines = line_rows(spark, path).where(strip(F.col("line")) != "")
    first = lines.groupBy("_path").agg(F.min_by("line", "row_idx").alias("head")).select("_path", _jsonl_kind(F.col("head")).alias("kind"))
    object_ = F.try_parse_json("line").isNotNull() & F.col("line").rlike(r"^\s*\{")
    good = lines.drop("row_idx").where(object_).join(F.broadcast(first.where("kind is not null")), "_path")  # a row for each file
    r = good.withColumn("r", F.from_json("line", _RECORD))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    zh, en = strip(text("zh_text")), strip(text("en_text"))
    accepted = r.where((F.col("kind") != "translation") | (zh != ""))
    rows = _numbered(accepted)
    joined = lambda array, field: F.array_join(F.filter(F.transform(F.col(f"r.`{array}`"), lambda x: x[field]), lambda x: x.isNotNull() & (x != "")), "\n")
    rendered = (
        F.when(F.col("kind") == "translation", F.when(en != "", translation(zh, en, F.col("row_idx"))).otherwise(zh))
        .when(F.col("kind") == "segments", joined("段落", "内容"))
        .when(F.col("kind") == "forum", F.concat(text("`主题`"), F.lit("\n\n"), joined("回复", "回复")))
        .when(F.col("kind") == "instruction", F.concat(text("instruction"), F.when(text("input") != "", F.concat(F.lit("\n"), text("input"))).otherwise(""), F.lit("\n"), text("output")))
        .otherwise(F.concat(text("`问`"), F.lit("\n"), text("`答`")))
    )
    out = rows.select(rendered.alias("text"), "source", "row_idx")
    return out if limit is None else out.where(F.col("row_idx") < limit)


def read_json_arrays(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(text, source, row_idx, file, whole) of the objects of files that each hold one JSON array (``array_objects``).

    A record's own source overrides the file's name; records without text are left out.
    ``limit`` keeps the first records with text of each file. Where ``whole`` is false the array
    is broken after these records: what is left of their texts beyond the last full chunk is no
    chunk (``chunk_records`` leaves it out).
    """
    found = array_objects(spark, path)
    r = found.withColumn("r", F.from_json("record", _RECORD)).withColumn("k", F.json_object_keys("record"))
    has, text = (lambda k: F.array_contains("k", k)), (lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")))
    asked = has("query") | has("thought") | has("answer")
    answer = F.concat_ws("\n", text("query"), text("thought"), F.coalesce(F.get_json_object("record", "$.answer"), F.lit("")))
    body = F.when(has("completion"), text("completion")).when(asked, answer).when(has("text"), text("text")).when(has("content"), text("content")).otherwise("")
    rows = r.select(body.alias("text"), F.coalesce(F.nullif(text("source"), F.lit("")), F.col("file")).alias("source"), "row_idx", "file", "whole", "path").where("text <> ''")
    if limit is not None:
        rows = with_offsets(rows, F.lit(1), "row_idx", ("path",), "_before").where(F.col("_before") < limit).drop("_before")
    return rows.drop("path")


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """text, or else content, of each line; files that are neither .jsonl nor .ndjson nor .json raise ValueError."""
    lines = spark.read.schema("text string, content string").json(path)
    others = sorted(f for f in lines.inputFiles() if not f.endswith((".jsonl", ".ndjson", ".json")))
    if others:
        raise ValueError(f"not JSON lines: {others[:3]}")
    return lines.select(F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit(""))).alias("text")).where("text is not null")


def read_chat_jsonl(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Chat records (_path, at, messages) in the order of files and lines, at most ``most``; a malformed line or one without messages fails the read with its number."""
    lines = line_rows(spark, path).withColumnRenamed("row_idx", "at").where(strip(F.col("line")) != "").orderBy("_path", "at")
    lines = lines.limit(most) if most is not None else lines
    bad = F.try_parse_json("line").isNull()
    missing = ~F.array_contains(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), "messages")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("at") + 1, F.lit(": invalid JSON")))).when(missing, F.raise_error(F.concat(F.lit("line "), F.col("at") + 1, F.lit(": no messages")))).otherwise(F.col("line"))
    return lines.select("_path", "at", F.from_json(checked, "messages array<struct<role:string,content:string>>")["messages"].alias("messages"))


def is_packed(df: DataFrame) -> bool:
    return {"token_ids", "seq_ids", "position_ids", "sequence_starts"} <= set(df.columns)


def is_packed_sft(df: DataFrame) -> bool:
    return is_packed(df) and {"target_loss_weights", "target_role_ids", "stp_span_starts", "stp_span_ends"} <= set(df.columns)


def detect_format(df: DataFrame, wanted: str = "auto") -> str:
    """packed or text; asking for packed rows of a table without them raises ValueError."""
    found = "packed" if is_packed(df) else "text"
    if wanted == "packed" and found != "packed":
        raise ValueError("the table holds no packed rows")
    return found if wanted == "auto" else wanted


def read_packed(spark: SparkSession, path: str, block: int) -> DataFrame:
    """Packed rows; ValueError if the manifest beside them, or the footer of any file, has another block size, and a failed read for rows of another length."""
    manifest = read_manifest(spark, path)
    if manifest.get("block_size", block) != block:
        raise ValueError(f"the shard has block_size={manifest['block_size']}, not {block}")
    others = footer_values(spark, path).where((F.col("key") == "block_size") & (F.col("value") != str(block))).select("file", "value").first()
    if others:
        raise ValueError(f"{others['file']} has block_size={others['value']}, not {block}")
    df = spark.read.parquet(path)
    missing = {"token_ids", "seq_ids", "position_ids", "sequence_starts"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    right = F.size("token_ids") == block + 1
    return df.withColumn("token_ids", F.when(right, F.col("token_ids")).otherwise(F.raise_error(F.lit(f"a row isn't {block + 1} tokens long"))))


def read_packed_sft(spark: SparkSession, path: str, block: int) -> DataFrame:
    """Packed rows for fine-tuning as samples (``sft_sample``); ValueError for another block size or missing columns."""
    df = read_packed(spark, path, block)
    missing = set(SFT_COLUMNS) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return sft_sample(df, block)


def read_text_shard(spark: SparkSession, path: str, column: str = "text", count: int = 1, index: int = 0, seed: int = 0, epoch: int = 0, buffer: int = 10_000) -> DataFrame:
    """(place, row_idx, text): every count-th text of a Parquet table from ``index`` on, counted over all its files, at its place after a shuffle through a buffer (``buffered_order``).

    Only this column is read. Null texts keep their row numbers and are left out in the end.
    """
    rows = with_row_numbers(spark, path, (column,)).withColumnRenamed(column, "text")
    own = buffered_order(rows, count, seed, epoch, buffer).where(F.col("shard") == index)
    return own.where("text is not null").select("place", "row_idx", "text")


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n_rows) of Parquet tables. No column is read: the counts come from the files' footers."""
    frames = [spark.read.parquet(p).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, p in paths.items()]
    return reduce(DataFrame.union, frames)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest that write_packed leaves in a table's folder, empty if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return {}
    return json.loads(spark.read.text(f"{path}/_manifest/*.txt").first()[0])


def read_bundle(spark: SparkSession, path: str, tasks: list[dict], labels: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A benchmark's tasks, baselines (task, baseline) and items (task, item, record as JSON); ``tasks`` is its parsed task list, ``labels`` picks some."""
    wanted = [t for t in tasks if not labels or t["label"] in labels]
    schema = "label string, icl_task_type string, dataset_uri string, num_fewshot int, continuation_delimiter string"
    frame = spark.createDataFrame([(t["label"], t["icl_task_type"], t["dataset_uri"], int(t.get("num_fewshot", 0)), t.get("continuation_delimiter", " ")) for t in wanted], schema)
    baselines = spark.read.option("header", True).csv(f"{path}/eval_meta_data.csv").select(F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline")).where("task is not null and baseline is not null")
    lines = spark.read.text(f"{path}/eval_data", wholetext=True, recursiveFileLookup=True).select(F.col(_FILE).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("item", "record")).where("record <> ''")
    items = lines.join(frame.select(F.col("label").alias("task"), F.element_at(F.split("dataset_uri", "/"), -1).alias("file")), "file").select("task", "item", "record")
    return frame, baselines, items


def synthetic_batches(spark: SparkSession, rows: int, length: int, vocabulary: int, segment: int, seed: int = 0) -> DataFrame:
    """Rows of random ids from 4 up, with jittered segments: token_ids, seq_ids and position_ids of each row."""
    jitter = lambda row, k: F.pmod(row + k, F.lit(3)) - 1
    size = lambda k: F.greatest(F.lit(segment) + jitter(F.col("id"), k) * max(1, segment // 8), F.lit(2))
    ks = F.sequence(F.lit(0), F.lit(length // 2))
    seqs = F.slice(F.flatten(F.transform(ks, lambda k: F.array_repeat(k, size(k).cast("int")))), 1, length)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(vocabulary - 4)) + 4).cast("int"))
    return spark.range(rows).select(F.col("id").alias("row_idx"), tokens.alias("token_ids"), seqs.alias("seq_ids")).withColumn("position_ids", F.transform("seq_ids", lambda s, i: i + 1 - F.array_position("seq_ids", s).cast("int")))
