"""Writers. Spark's committers make each of them all or nothing."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators.metrics import json_safe
from corpusmill.sources.files import noted

ROW_GROUP = 512  # packed rows


def write_text(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """text and source as snappy Parquet; an existing table is an error unless ``overwrite``."""
    df.select("text", "source").write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)


def write_packed(df: DataFrame, path: str, block: int, overwrite: bool = False, form: str = "packed-v1", by: tuple[str, ...] = (), **manifest) -> None:
    """Packed rows as zstd Parquet with a manifest, each row's sequences numbered from 0; with ``by`` in a folder for each value of these columns.

    Every task writes the rows it has, so a folder's files are as many as tasks. Rows whose arrays aren't block + 1 long, or whose span arrays differ in length, fail the write.
    """
    arrays = [c for c in ("token_ids", "seq_ids", "position_ids", "sequence_starts", "target_loss_weights", "target_role_ids") if c in df.columns]
    right = F.lit(True)
    for c in arrays:
        right = right & (F.size(c) == block + 1)
    if {"stp_span_starts", "stp_span_ends"} <= set(df.columns):
        right = right & (F.size("stp_span_starts") == F.size("stp_span_ends"))
    if "seq_ids" in df.columns:  # padding, below 0, stays
        first = F.array_min(F.filter("seq_ids", lambda s: s >= 0))
        moved = let(first, lambda f: F.transform("seq_ids", lambda s: F.when(s >= 0, s - f).otherwise(s)))
        df = df.withColumn("seq_ids", F.when(F.array_min("seq_ids") == 0, F.col("seq_ids")).otherwise(moved))  # most rows begin at 0, and lambdas are slow
    checked = df.withColumn(arrays[0], F.when(right, F.col(arrays[0])).otherwise(F.raise_error(F.lit(f"a row isn't {block + 1} tokens long, or its spans have no end"))))
    checked = noted(checked, arrays[0], block_size=block, format=form)  # in the footer of every file
    writer = checked.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    # places follow each other, so differences are smaller and faster than a dictionary; a batch that is read holds one row group at most, whose lists are long
    writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.row.count.limit", ROW_GROUP)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    note = json.dumps({"format": form, "block_size": block, **manifest}, sort_keys=True)
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with sorted keys, non-ASCII as it is, numbers that aren't finite as null, nested ones too."""
    safe = {f.name: json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema}
    df.select(*(safe[c] for c in sorted(df.columns))).write.mode("append").option("ignoreNullFields", False).json(path)


def write_json_arrays(df: DataFrame, path: str, record: Column, order: str, files: int, part: Column | None = None) -> None:
    """``record``, JSON as text, of all rows as ``files`` JSON arrays: row ``order`` (an integer) goes to file ``part``, order % files by default, at its place by order. Each file is written by a task of its own."""
    part = (F.pmod(F.col(order), F.lit(files)) if part is None else part).cast("int")
    lines = df.select(part.alias("part"), F.lit(1).alias("kind"), F.col(order).alias("at"), record.alias("value"))
    firsts = lines.groupBy("part").agg(F.min("at").alias("first"))
    lines = lines.join(F.broadcast(firsts), "part").withColumn("value", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), "value")).drop("first")
    ends = df.sparkSession.range(files).select(F.col("id").cast("int").alias("part"), F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(2)), F.array(F.lit("["), F.lit("]")))).alias("kind", "value"))
    rows = lines.unionByName(ends.withColumn("at", F.lit(None).cast(lines.schema["at"].dataType)))
    rows.repartitionById(files, "part").sortWithinPartitions("part", "kind", "at").select("value").write.text(path)


def write_verified(df: DataFrame, path: str) -> int:
    """Write Parquet and compare the rows that went in, counted while they are written, with those read back; RuntimeError if they differ."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    wanted, found = seen.get["n"], df.sparkSession.read.parquet(path).count()
    if wanted != found:
        raise RuntimeError(f"{found} rows were written of {wanted}")
    return found


def write_summary(spark: SparkSession, path: str, summary: dict, command: str | None = None) -> None:
    """A JSON summary, and beside it the best command as text, each one file in a folder of its own."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    if command is not None:
        spark.createDataFrame([(command,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/command")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir; where that is unset, in local mode only, below a new folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as written to a new path below the shared folder and read again: worked out once, and tasks that run again read the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """df as a Parquet table at path: read if it is there, else written first. Keeps what is costly to make, such as tokens."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
