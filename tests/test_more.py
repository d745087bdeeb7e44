import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat, intervals, metrics, rows
from corpusmill.plans import score_queries, text_queries
from corpusmill.sources.render import translation
from tests.compare import same

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_windows_of_a_stream(spark):
    got = value(spark, intervals.sample_windows(F.array(*map(F.lit, range(10))), F.lit(3), 4))
    assert (got.inputs, got.targets) == ([3, 4, 5, 6], [4, 5, 6, 7])


def test_collated_spans(spark):
    df = spark.createDataFrame([(0, 1, [(1, 4), (6, 9)]), (0, 2, []), (1, 3, [(0, 3)])], "batch int, row int, spans array<struct<begin:int,end:int>>")
    got = {r.row: ([tuple(s) for s in r.spans], r.span_mask) for r in intervals.collate_spans(df).collect()}
    assert got == {1: ([(1, 4), (6, 9)], [True, True]), 2: ([(0, 0), (0, 0)], [False, False]), 3: ([(0, 3)], [True])}


def test_left_truncation(spark):
    got = value(spark, metrics.left_truncated(F.array(*map(F.lit, range(6))), F.lit(1), F.lit(6), 4))
    assert (got.ids, got.begin, got.end) == ([2, 3, 4, 5], 0, 4)
    assert metrics.step_cap(10, 4) == 3


def test_prefix_split(spark):
    got = rows.prefix_split(spark.range(25).withColumnRenamed("id", "row_idx"), 0.9)
    assert [r.row_idx for r in got.where("not is_train").orderBy("row_idx").collect()] == [22, 23, 24]


def test_lists(spark):
    assert value(spark, chat.parse_values(F.lit("1, 2,3"), "int")) == [1, 2, 3]
    with pytest.raises(Exception, match="the list is empty"):
        value(spark, chat.parse_values(F.lit(" , "), "int"))


def test_translations_of_whole_texts(spark):
    """The registered query and its SQL render the first 40 characters; here both render all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = docs.select("doc_id", F.md5(translation(F.col("text"), F.col("source"), F.col("doc_id"))).alias("digest"))
    same(got, SF, text_queries.TRANSLATION_ROTATION.replace("substr(text, 1, 40)", "text"))


def test_stability_penalty_of_all_events(spark):
    """The registered query and its SQL take three of ten residues of event_id as measurements; here every event is one."""
    kind, v = F.col("event_id") % 3, F.abs("value")
    e = spark.read.parquet(f"{SF}/events.parquet").groupBy((F.col("user_id") % 40).alias("trial"))
    runs = e.agg(F.array_sort(F.collect_list(F.when(kind == 0, F.struct("event_id", v.alias("v"))))).alias("e"), F.collect_list(F.when(kind == 1, v)).alias("t"), F.collect_list(F.when(kind == 2, v / 40)).alias("g"), F.count_if(v > 90).alias("clipped"), F.count("*").alias("steps"), F.max(v).alias("peak"))
    got = runs.select("trial", F.round(metrics.stability_penalty(F.col("e.v"), F.col("t"), F.col("g"), F.col("clipped"), F.col("steps"), F.col("peak"), 1.0, 50.0), 6).alias("penalty"))
    same(got, SF, score_queries.STABILITY.replace("event_id % 10", "event_id % 3"))
