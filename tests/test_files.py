import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rows
from corpusmill.sources import files, readers, sinks


def test_arithmetic_of_64_bits(spark):
    rng, top = random.Random(1), 1 << 64
    xs = [0, 1, top - 1, 1 << 63, (1 << 63) - 1, *(rng.randrange(top) for _ in range(200))]
    signed = lambda x: x - top if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in xs], "x long")
    for y in (0, 1, 0x94D049BB133111EB, top - 1, -5):
        got = df.select("x", rows.wrapped_sum(F.col("x"), y).alias("s"), rows.wrapped_product(F.col("x"), y).alias("p")).collect()
        assert {(r.x % top, r.s % top, r.p % top) for r in got} == {(x, (x + y) % top, x * y % top) for x in xs}
    for n in (1, 7, 128, (1 << 31) - 1):
        assert {(r.x % top, r.b) for r in df.select("x", rows.bucket_of("x", n).alias("b")).collect()} == {(x, min(n - 1, x * n >> 64)) for x in xs}


def test_shuffled_files(spark, tmp_path):
    before = dict(spark.conf.getAll)
    df = spark.range(3000).selectExpr("id AS row_idx", "id * 2 AS value")
    files.write_shuffled(df.repartition(5), f"{tmp_path}/a", 7, "x.parquet", buckets=16)
    files.write_shuffled(df, f"{tmp_path}/b", 7, "x.parquet", buckets=3)
    orders = [[r.row_idx for r in files.with_row_numbers(spark, f"{tmp_path}/{n}", name="at").orderBy("at").collect()] for n in "ab"]
    wanted = [r[0] for r in rows.shuffle_rows(df, 7, "x.parquet").collect()]
    assert orders == [wanted, wanted] and dict(spark.conf.getAll) == before
    assert spark.read.parquet(f"{tmp_path}/a").columns == ["row_idx", "value"]
    with pytest.raises(Exception, match="exists"):
        files.write_shuffled(df, f"{tmp_path}/a", 7, "x.parquet")


def test_row_numbers_over_files_need_no_shuffle(spark, tmp_path):
    spark.range(100).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    found = files.with_row_numbers(spark, f"{tmp_path}/t")
    assert all(r.id == r.row_idx for r in found.collect()) and found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(_file" not in plan


def plain(numbers, seed, buffer):
    draw, held, out = random.Random(seed), [], []
    for x in numbers:
        held.append(x)
        if len(held) >= buffer:
            out.append(held.pop(draw.randrange(len(held))))
    draw.shuffle(held)
    return out + held


@pytest.mark.parametrize(("count", "buffer"), [(1, 7), (3, 1), (3, 16), (2, 1000)])
def test_buffered_order(spark, count, buffer):
    df = spark.range(200).selectExpr("id AS row_idx", "id AS place_")
    got = rows.buffered_order(df.repartition(6), count, 11, epoch=2, buffer=buffer).orderBy("shard", "place").collect()
    for shard in range(count):
        assert [r.row_idx for r in got if r.shard == shard] == plain(range(shard, 200, count), 11 + 2 * 1009 + shard, buffer)


def test_text_shards(spark, tmp_path):
    spark.createDataFrame([(f"t{i}" if i % 7 else None,) for i in range(50)], "text string").repartitionByRange(4, "text").write.parquet(f"{tmp_path}/t")
    whole = {r.row_idx: r.text for r in files.with_row_numbers(spark, f"{tmp_path}/t").collect()}
    got = [r for i in range(3) for r in readers.read_text_shard(spark, f"{tmp_path}/t", count=3, index=i, buffer=5).collect()]
    assert {r.row_idx: r.text for r in got} == {k: v for k, v in whole.items() if v is not None}


def test_block_sizes_in_footers(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 3], [0, 0, 0], [0, 1, 2], [True, False, False])] * 4, "token_ids array<int>, seq_ids array<int>, position_ids array<int>, sequence_starts array<boolean>")
    sinks.write_packed(df.repartition(3), f"{tmp_path}/p", 2)
    assert {(r.n_rows > 0, r.value) for r in files.footer_values(spark, f"{tmp_path}/p").where("key = 'block_size'").collect()} == {(True, "2")}
    assert readers.read_packed(spark, f"{tmp_path}/p", 2).count() == 4
    files.noted(df, "token_ids", block_size=9).write.mode("append").parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="block_size=9"):
        readers.read_packed(spark, f"{tmp_path}/p", 2)
    assert files.footer_values(spark, f"{tmp_path}/p").where("key = 'org.apache.spark.version'").count() >= 4


def test_footers_of_groups_that_several_tasks_wrote(spark, tmp_path):
    df = spark.range(40, numPartitions=5).select(*(F.array(F.lit(v), F.lit(v), F.lit(v)).alias(c) for c, v in (("token_ids", 1), ("seq_ids", 0), ("position_ids", 0), ("sequence_starts", False))), (F.col("id") % 2).alias("group"))
    sinks.write_packed(df, f"{tmp_path}/g", 2, by=("group",))
    found = files.footer_values(spark, f"{tmp_path}/g").where("key = 'format'").collect()
    assert {g: sorted(r.n_rows for r in found if r.folder == f"group={g}") for g in (0, 1)} == {0: [4] * 5, 1: [4] * 5}
    assert readers.read_packed(spark, f"{tmp_path}/g", 2).count() == 40
