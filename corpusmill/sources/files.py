"""Rows numbered over all files of a table, tables written in a shuffled order, and Parquet footers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.rows import bucket_of, file_seed, splitmix64, unsigned_order, wrapped_sum

BUCKETS = 128
SPARK_SCHEMA = "org.apache.spark.sql.parquet.row.metadata"


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, base) of a Parquet table: each file's rows, and those of the files before it by path. Rows come from the footers, no column is read."""
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return counts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def with_row_numbers(spark: SparkSession, path: str, columns: tuple[str, ...] = (), name: str = "row_idx") -> DataFrame:
    """A Parquet table's columns (all of them by default) with each row's number over all files, in the order of their paths.

    A row's number is its place in its file and the rows of the files before: no shuffle and no
    sort. Files without rows count for nothing.
    """
    table = spark.read.parquet(path)
    table = table.select(*(F.col(f"`{c}`") for c in columns or table.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    bases = file_bases(spark, path).select(F.col("file").alias("_file"), "base")
    # a row for each file, whose list the driver holds anyway
    return table.join(F.broadcast(bases), "_file").withColumn(name, F.col("base") + F.col("_row")).drop("_file", "_row", "base")


def write_shuffled(df: DataFrame, path: str, seed: int, name: str, order: str = "row_idx", buckets: int = BUCKETS, compression: str = "zstd", overwrite: bool = False) -> None:
    """df as Parquet in a random order that follows from seed, name and row number alone.

    A row's key is splitmix64 of its number and the seed. Keys are dealt to ``buckets`` ranges,
    each is sorted by a task of its own and becomes the files of one part; files by path are
    the whole order, so ``with_row_numbers`` gives places. The key isn't written.
    """
    keyed = splitmix64(df, wrapped_sum(F.col(order).cast("long"), file_seed(seed, name)), "_key")
    dealt = keyed.repartitionById(buckets, bucket_of("_key", buckets)).sortWithinPartitions(unsigned_order("_key"), order)
    dealt.drop("_key").write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(path)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            store, own = fs.FileSystem.from_uri(path)
            with store.open_input_file(own) as f:
                footer = pq.read_metadata(f)
            found = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (footer.metadata or {}).items()}
            for field in json.loads(found.get(SPARK_SCHEMA, "{}")).get("fields", []):
                found |= {k: str(v) for k, v in field["metadata"].items()}
            folder, name = path.rsplit("/", 1)
            rows += [{"folder": folder.rsplit("/", 1)[1], "file": name, "n_rows": footer.num_rows, "key": k, "value": v} for k, v in sorted(found.items())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("folder", pa.string()), ("file", pa.string()), ("n_rows", pa.int64()), ("key", pa.string()), ("value", pa.string())]))


def footer_values(spark: SparkSession, path: str, files_a_task: int = 64) -> DataFrame:
    """(folder, file, n_rows, key, value) of the key-values in the footer of each file of a Parquet table, and of the notes that its columns carry; folder is the name of the one that the file lies in.

    Tasks open ``files_a_task`` files and read their footers alone; stores are those that Arrow
    opens. A file without key-values gives no row.
    """
    names = spark.read.parquet(path).inputFiles()
    files = spark.createDataFrame([(n,) for n in names], "path string")
    return files.repartition(max(1, -(-len(names) // files_a_task))).mapInArrow(_footers, "folder string, file string, n_rows long, key string, value string")


def noted(df: DataFrame, column: str, **notes) -> DataFrame:
    """df whose ``column`` carries notes, which its Parquet files' footers then hold."""
    return df.withColumn(column, F.col(column).alias(column, metadata={k: str(v) for k, v in notes.items()}))
