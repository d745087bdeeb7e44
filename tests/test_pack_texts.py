import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusmill.functions.text import code_points
from corpusmill.operators import intervals
from corpusmill.plans import sequence_queries as q
from corpusmill.sources import readers, sinks
from tests.compare import same

SF = "/root/testdata/sf0.001"


def _both(spark, rows, block, windows):
    docs = spark.createDataFrame(rows, "row_idx long, text string")
    packed = intervals.pack_texts(docs, block, windows=windows)
    wanted = intervals.pack_tokens(docs.where("text is not null"), block, tokens=code_points(F.col("text")), size=F.length("text"))
    assert packed.columns == wanted.columns
    return sorted(packed.collect()), sorted(wanted.collect())


def test_texts_pack_as_their_tokens_do(spark):
    rng = random.Random(5)
    texts = ["ab\x01", "", None, "x", "é€😀\x00" * 40, "long" * 300, *("".join(rng.choices("aé😀\n", k=rng.randint(0, 30))) for _ in range(60))]
    rows = [(i * 97, t) for i, t in enumerate(texts)]
    for block, windows in ((4, 3), (4, 1), (7, 64)):
        got, wanted = _both(spark, rows, block, windows)
        assert got == wanted and len(got) > 100
    total = sum(len(t) for t in texts if t and len(t) > 1)
    for block, n in ((total - 1, 1), (total, 0), (total + 5, 0)):  # one window to the last token, and none
        got, wanted = _both(spark, rows, block, 2)
        assert got == wanted and len(got) == n


def test_bytes_that_are_no_text_are_packed(spark):
    docs = spark.range(3).select(F.col("id").alias("row_idx"), F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    assert [r.token_ids for r in intervals.pack_texts(docs, 4).orderBy("window").collect()] == [[97, 0xFFFD, 98, 97, 0xFFFD], [0xFFFD, 98, 97, 0xFFFD, 98]]


def test_packing_and_sums_make_no_token_by_a_lambda_or_for_python(spark):
    packed = q.packed(spark, SF)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "ascii(" not in plan and "lambda" not in plan
    sums = q.pack_sums(spark.createDataFrame([], packed.schema))
    assert "Python" not in sums._jdf.queryExecution().optimizedPlan().toString()


def test_written_windows_have_no_dictionaries_and_sum_alike(spark, tmp_path):
    path = f"{tmp_path}/p"
    sinks.write_packed(q.packed(spark, SF), path, q.BLOCK)
    for name in glob.glob(f"{path}/*.parquet"):
        footer = pq.read_metadata(name)
        for g in range(footer.num_row_groups):
            assert not any(footer.row_group(g).column(c).has_dictionary_page for c in range(footer.num_columns))
    same(q.pack_sums(readers.read_packed(spark, path, q.BLOCK)), SF, q.PACK_BLOCKS)


def test_row_groups_are_small(spark, tmp_path):
    df = spark.range(0, 1100, 1, 1).select(F.array(*[F.col("id").cast("int")] * 3).alias("token_ids"), F.array(*[F.lit(0)] * 3).alias("seq_ids"))
    sinks.write_packed(df, f"{tmp_path}/g", 2)
    (name,) = glob.glob(f"{tmp_path}/g/*.parquet")
    assert [pq.read_metadata(name).row_group(g).num_rows for g in range(3)] == [512, 512, 76]
