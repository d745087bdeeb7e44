import random

from pyspark.sql import functions as F

from corpusmill.functions.text import code_points
from corpusmill.operators import intervals, rows

PACKED = ([10, 11, 1, 20, 21, 1, 30], [0, 0, 0, 1, 1, 1, 2], [True, False, False, True, False, False, True])


def test_labels_and_masks(spark):
    df = spark.createDataFrame([PACKED], "t array<int>, s array<int>, b array<boolean>")
    r = df.select(intervals.shifted_labels(F.col("t"), F.col("s"), 6), intervals.loss_mask(F.col("s"), 6), intervals.start_mask(F.col("b"), 6), intervals.causal_mask(F.slice("s", 1, 6)), intervals.visible_keys(F.slice("s", 1, 6))).first()
    assert r[0] == [11, 1, -100, 21, 1, -100]
    assert r[1] == [1, 1, 0, 1, 1, 0]
    assert r[2] == [True, False, False, True, False, False]
    assert ["".join(str(int(x)) for x in row) for row in r[3]] == ["100000", "110000", "111000", "000100", "000110", "000111"]
    assert r[4] == [1, 2, 3, 1, 2, 3]


def test_packing(spark):
    docs = spark.createDataFrame([(0, [5, 6, 1]), (1, [7, 1]), (2, [1]), (3, [8, 9, 10, 1])], "row_idx long, tokens array<int>")
    got = [tuple(r) for r in intervals.pack_tokens(docs, 4).orderBy("window").collect()]
    assert got == [
        (0, [5, 6, 1, 7, 1], [0, 0, 0, 1, 1], [0, 1, 2, 0, 1], [True, False, False, True, False]),
        (1, [1, 8, 9, 10, 1], [0, 1, 1, 1, 1], [1, 0, 1, 2, 3], [False, True, False, False, False]),
    ]


def test_padded_packing(spark):
    docs = spark.createDataFrame([(0, [10, 11, 12, 13, 14, 15], [1.0] * 6)], "row_idx long, tokens array<int>, w array<double>")
    got = intervals.pack_tokens(docs, 4, pad=0, extra=("w",)).orderBy("window").collect()
    assert [r.token_ids for r in got] == [[10, 11, 12, 13, 14], [14, 15, 0, 0, 0]]
    assert got[1].seq_ids == [0, 0, -1, -1, -1] and got[1].w == [1, 1, 0, 0, 0]


def test_chunks_keep_all_characters(spark):
    rng = random.Random(3)
    texts = ["x" * 1999, "y" * 5, " " * 30, "😀" * 4100, "", *("ab " * rng.randint(1, 900) for _ in range(20))]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "row_idx long, text string, source string")
    got = intervals.chunk_texts(df).collect()
    for source in "ab":
        whole = "".join(t + "\n\n" for i, t in enumerate(texts) if "ab"[i % 2] == source and t)
        wanted = [whole[k : k + 2000].strip() for k in range(0, len(whole), 2000)]
        assert [r.text for r in sorted((r for r in got if r.source == source), key=lambda r: r.chunk)] == [w for w in wanted if w]


def test_span_clips(spark):
    rng = random.Random(5)
    spans, at = [], 0
    for _ in range(200):
        at += rng.randint(0, 9)
        spans.append((at, at + rng.randint(0, 30)))
        at = spans[-1][1]
    total, block = at + 4, 16
    wanted = []
    for k in range(-(-(total - 1) // block)):
        stop = min(k * block + block, min(k * block + block + 1, total) - 1)
        wanted += [(k, max(b, k * block) - k * block, min(e, stop) - k * block) for b, e in spans if min(e, stop) - max(b, k * block) >= 3]
    got = intervals.clip_spans(spark.createDataFrame(spans, "begin long, end long"), block, total)
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


def _mix(x):
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return x ^ (x >> 31)


def test_shuffle_order(spark):
    df = spark.range(500).withColumnRenamed("id", "row_idx")
    seed = rows.file_seed(7, "a.parquet") % (1 << 64)
    wanted = sorted(range(500), key=lambda i: _mix((seed + i) % (1 << 64)))
    assert [r[0] for r in rows.shuffle_rows(df.repartition(7), 7, "a.parquet").collect()] == wanted
    assert [r[0] for r in rows.shuffle_rows(df, 7, "b.parquet").collect()] != wanted


def test_split_and_shards(spark):
    df = spark.range(150).withColumnRenamed("id", "row_idx")
    assert rows.split_by_hash(df, "row_idx", 0.03, 1).where("is_val").count() == round(150 * 0.03)
    parts = [{r[0] for r in rows.shard(df, 4, i).collect()} for i in range(4)]
    assert set().union(*parts) == set(range(150)) and sum(map(len, parts)) == 150
    sizes = spark.range(4).select(rows.shard_rows(F.lit(150), 4, F.col("id"))).collect()
    assert [r[0] for r in sizes] == [len(p) for p in parts]


def test_dedup_keeps_the_first_stage(spark):
    df = spark.createDataFrame([("x", 1, 0, "s1"), ("x", 0, 5, "s-init"), ("y", 1, 1, "s1")], "text string, stage_ord int, row_idx int, source string")
    assert {(r.text, r.source) for r in rows.dedup_first(df).collect()} == {("x", "s-init"), ("y", "s1")}


def test_tokens_made_after_offsets_pack_alike(spark):
    docs = spark.createDataFrame([(0, "abc"), (600, "d"), (5000, "efghij"), (5001, "")], "row_idx long, text string")
    ids = F.concat(code_points(F.col("text")), F.array(F.lit(1)))
    late = intervals.pack_tokens(docs, 4, tokens=ids, size=F.length("text") + 1)
    early = intervals.pack_tokens(docs.select("row_idx", ids.alias("tokens")), 4)
    assert late.columns == early.columns and sorted(late.collect()) == sorted(early.collect()) and late.count() == 3


def test_places_are_not_shuffled(spark):
    docs = spark.createDataFrame([(0, [1, 2, 3])], "row_idx long, tokens array<int>")
    plan = intervals.pack_tokens(docs, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(offset" in plan and "low" in plan and ", p, " not in plan


def test_visible_keys_of_null_and_empty_rows(spark):
    rows = spark.createDataFrame([(0, [7, 7, 8, -1]), (1, None), (2, []), (3, [8, 8])], "k int, s array<int>")
    got = {r.k: r for r in rows.select("k", intervals.visible_keys(F.col("s")).alias("v"), intervals.visible_keys(F.col("s"), 1).alias("w"), intervals.loss_mask(F.col("s"), 3).alias("m")).collect()}
    assert [got[k].v for k in range(4)] == [[1, 2, 1, 0], None, [], [1, 2]]
    assert got[0].w == [1, 1, 1, 0] and got[3].w == [1, 1]
    assert got[0].m == [1.0, 0.0, 0.0] and got[1].m is None and got[3].m == [1.0]


def test_a_long_shard_is_dealt_by_runs_of_windows(spark):
    texts = ["ab" * 9, None, "", "c", "defg" * 30, "h"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")
    ids = F.concat(F.transform(F.split("text", ""), lambda c: F.ascii(c)), F.array(F.lit(1)))
    dealt = intervals.deal_tokens(docs, 4, 3, ids, F.when(F.col("text") != "", F.length("text") + 1), 2).collect()
    for shard in (0, 1):
        stream = [t for n, text in enumerate(texts) if n % 2 == shard and text for t in [*map(ord, text), 1]]
        for run in range(-(-len(stream) // 12)):
            own = sorted((r.row_idx, r.tokens) for r in dealt if (r.shard, r.run) == (shard, run))
            assert [t for _, ts in own for t in ts] == stream[run * 12 : run * 12 + 13]
    assert {r.shard for r in dealt} == {0, 1} and max(r.run for r in dealt) > 10
