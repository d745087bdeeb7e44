import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import __main__ as command_line
from corpusmill.operators import checks, metrics, numerics, rows, search
from corpusmill.plans import source_queries
from corpusmill.sources import readers, sinks
from corpusmill.sql import register_views

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text", ["8:4", "8:4:maybe", "0:4:gc", "x:4:gc", "8:-1:1", " , "])
def test_bad_candidates(spark, text):
    with pytest.raises(Exception, match="candidate|flag|positive|empty"):
        value(spark, search.parse_candidates(F.lit(text)))


def test_number_text(spark):
    numbers = [0.0, 1.0, 0.125, 1234.5, 100.0, 0.001, 2e-05, 0.1]
    assert value(spark, F.array(*(search.number_text(F.lit(x)) for x in numbers))) == ["0", "1", "0.125", "1234.5", "100", "0.001", "0.00002", "0.1"]


def test_losses_that_can_not_be(spark):
    for bad in (float("nan"), float("inf"), -0.1):
        with pytest.raises(Exception, match="loss"):
            value(spark, checks.checked_loss(F.lit(bad)))


def test_sane_batches(spark):
    good = ([0, 9], [-100, 9], [0.0, 1.0], [0, 1])
    for k, bad in ((0, [0, 10]), (0, [-1, 2]), (1, [-1, 2]), (2, [0.0, float("nan")]), (2, [0.0, 1.5]), (3, [-1, 0])):
        for fields, wanted in ((good, True), (good[:k] + (bad,) + good[k + 1 :], False)):
            ids, labels, mask, at = (F.array(*map(F.lit, x)) for x in fields)
            assert value(spark, checks.is_sane(ids, labels, mask, at, 10)) is wanted


SFT = "token_ids array<int>, seq_ids array<int>, position_ids array<int>, sequence_starts array<boolean>, target_loss_weights array<double>, target_role_ids array<int>, stp_span_starts array<int>, stp_span_ends array<int>"


def test_sft_sample(spark):
    row = ([10, 11, 12, 20, 21], [0, 0, 0, 1, 1], [0, 1, 2, 0, 1], [True, False, False, True, False], [0.0, 1.0, 0.5, 1.0, 1.0], [0, 4, 4, 4, 4], [0, 1, 0], [3, 3, 5])
    got = checks.sft_sample(spark.createDataFrame([row], SFT), 4).first()
    assert (got.input_ids, got.labels, got.loss_mask) == ([10, 11, 12, 20], [11, 12, -100, 21], [1.0, 0.5, 0.0, 1.0])
    assert (got.target_role_ids, got.sequence_start_mask, [tuple(s) for s in got.spans]) == ([4, 4, 4, 4], [True, False, False, True], [(0, 3)])
    for bad in (row[:7] + ([3],), ([1],) + row[1:]):
        with pytest.raises(Exception, match="span starts|fields aren't"):
            checks.sft_sample(spark.createDataFrame([bad], SFT), 4).collect()


def test_sft_files(spark, tmp_path):
    row = ([10, 11, 12, 20, 21], [3, 3, 3, 4, -1], [0, 1, 2, 0, 1], [True, False, False, True, False], [1.0] * 5, [4] * 5, [0], [3])
    df = spark.createDataFrame([row], SFT)
    sinks.write_packed(df, f"{tmp_path}/a", 4, form="packed-sft-v1")
    assert readers.read_packed(spark, f"{tmp_path}/a", 4).first().seq_ids == [0, 0, 0, 1, -1]
    assert readers.read_packed_sft(spark, f"{tmp_path}/a", 4).first().labels == [11, 12, -100, -100]
    with pytest.raises(ValueError, match="block_size=4"):
        readers.read_packed_sft(spark, f"{tmp_path}/a", 5)
    df.drop("stp_span_ends").write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="stp_span_ends"):
        readers.read_packed_sft(spark, f"{tmp_path}/b", 4)


@pytest.mark.parametrize(("n", "ratio", "wanted"), [(4, 0.25, 1), (4, 0.0, 0), (1, 0.5, 0), (2, 0.99, 1), (0, 0.5, 0), (10, 0.25, 2)])
def test_sft_split(spark, n, ratio, wanted):
    assert rows.sft_split(spark.range(n), "id", ratio).where("is_val").count() == wanted


def test_sft_split_checks_its_ratio(spark):
    with pytest.raises(ValueError, match="ratio"):
        rows.sft_split(spark.range(3), "id", 1.0)


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("\n".join("" if i % 7 == 0 else f"{k} line {i} " + "x" * 60 for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        found = readers.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert sorted((r.source, r.row_idx, r.text.split(" x")[0]) for r in found.collect()) == sorted((f"{k}.txt", i, f"{k} line {i}") for k in range(2) for i in range(500) if i % 7)
        assert readers.read_lines(spark, str(tmp_path), limit=8).count() == 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_limits_and_suffixes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"instruction": "i", "output": str(i)}) if i % 3 else "broken {" for i in range(1, 30)))
    assert [r.row_idx for r in readers.read_jsonl_text(spark, str(tmp_path), limit=5).orderBy("row_idx").collect()] == [0, 1, 2, 3, 4]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps([{"text": str(i)} for i in range(9)]))
    assert readers.read_json_arrays(spark, f"{tmp_path}/sub", limit=4).count() == 4
    (tmp_path / "c.txt").write_text('{"text": "x"}')
    with pytest.raises(ValueError, match="c.txt"):
        readers.read_corpus_jsonl(spark, f"{tmp_path}/c.txt")


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"a": float("-inf")}, 3)], "a double, b array<double>, c map<string,double>, d int")
    row = df.select(*(metrics.json_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).first()
    assert tuple(row) == (None, [1.0, None], {"a": None}, 3)


def test_summary_files(spark, tmp_path):
    sinks.write_summary(spark, f"{tmp_path}/s", {"b": 1, "a": "é"}, "python -m x")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/s/summary", wholetext=True).collect())) == {"a": "é", "b": 1}
    assert spark.read.text(f"{tmp_path}/s/command").first()[0] == "python -m x"


def test_special_tokens(spark):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "token string, id int")
    with pytest.raises(ValueError, match="several"):
        checks.register_tokens(vocabulary, ["b"])
    got = {r.token: (r.id, r.is_special) for r in checks.register_tokens(vocabulary.where("id < 2"), ["<x>", "a", "<x>"]).collect()}
    assert got == {"a": (0, True), "b": (1, False), "<x>": (2, True)}


def test_recurrence_like_a_loop(spark):

    rng, d, steps = np.random.default_rng(1), 3, []
    for seq in range(2):
        steps += [(seq, t, t == 4, *(rng.standard_normal(d).round(3).tolist() for _ in range(6))) for t in range(9)]
    df = spark.createDataFrame(steps, "seq long, t long, reset boolean, r array<double>, k array<double>, v array<double>, w array<double>, a array<double>, b array<double>")
    got, state = {(x.seq, x.t): x.out for x in numerics.recurrence(df, d).collect()}, None
    for seq, t, reset, *vectors in steps:
        r, k, v, w, a, b = map(np.array, vectors)
        if t == 0 or reset:
            state = np.zeros((d, d))
        state = state * w + np.outer(state @ a, b) + np.outer(v, k)
        assert np.allclose(got[seq, t], state @ r)


def test_recurrence_is_a_scan_over_chunks(spark):
    """One sequence without resets, over three levels of groups, and one with gaps; as many tasks as chunks fill."""
    rng, d, n = np.random.default_rng(7), 3, 3000
    x = {c: rng.standard_normal((n, d)) * (0.3 if c in "ab" else 1) for c in "rkvab"} | {"w": rng.uniform(0.5, 0.99, (n, d))}
    steps = [(s, t * (1 + s), bool(s and t % 700 == 5), *(x[c][t].tolist() for c in "rkvwab")) for s in (0, 1) for t in range(n)]
    df = spark.createDataFrame(steps, "seq long, t long, reset boolean, r array<double>, k array<double>, v array<double>, w array<double>, a array<double>, b array<double>")
    found = numerics.recurrence(df.repartition(5), d, chunk=16, group=4)
    got = {(r.seq, r.t): r.out for r in found.collect()}
    assert len(got) == 2 * n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found.withColumn("task", F.spark_partition_id()).where("seq = 0").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in (0, 1):
        state = np.zeros((d, d))
        for t in range(n):
            state = state * (not (s and t % 700 == 5))
            state = state * x["w"][t] + np.outer(state @ x["a"][t], x["b"][t]) + np.outer(x["v"][t], x["k"][t])
            assert np.allclose(got[s, t * (1 + s)], state @ x["r"][t], rtol=1e-9, atol=1e-9)
    assert numerics.recurrence(df.limit(0), d).count() == 0


def test_rotary_keeps_lengths(spark):
    x = F.array(*(F.lit(float(i)) for i in range(8)))
    got = value(spark, numerics.rotary(x, F.lit(5.0), 8))
    assert math.isclose(sum(v * v for v in got), sum(i * i for i in range(8))) and value(spark, numerics.rotary(x, F.lit(0.0), 8)) == [float(i) for i in range(8)]


def test_views_and_command_line(spark, tmp_path, capsys):
    assert set(register_views(spark, SF, ("candidates",))) == {*source_queries.TABLES, "q_candidates"}
    assert spark.sql("SELECT count(*) FROM q_candidates JOIN part USING (p_partkey)").first()[0] == 200
    with pytest.raises(ValueError, match="no such"):
        register_views(spark, SF, ("nothing",))
    command_line.main(["list"])
    assert "pack_blocks" in capsys.readouterr().out.split()
    for words in (["clean"], ["split", "--val-ratio", "0.25"], ["pack", "--block-size", "128"], ["shuffle", "--limit", "50"]):
        command_line.main([words[0], f"{SF}/documents.parquet", f"{tmp_path}/{words[0]}", *words[1:]])
    assert spark.read.parquet(f"{tmp_path}/shuffle").count() == 50
    assert spark.read.parquet(f"{tmp_path}/split").where("is_val").count() == round(0.25 * spark.read.parquet(f"{tmp_path}/split").count())
    command_line.main(["sql", "SELECT r_name FROM region", SF, "--out", f"{tmp_path}/sql"])
    assert spark.read.parquet(f"{tmp_path}/sql").count() == 5


def test_build_and_pack_sft_commands(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text":"abcd","source":"x"},{"text":"efgh","source":"y"}]')
    command_line.main(["build", "json", f"{tmp_path}/a.json", f"{tmp_path}/chunks", "--chunk-size", "6"])
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {("abcd", "x"), ("efgh", "y")}
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"问": f"q{i}", "答": "a"}, ensure_ascii=False) + "\n" for i in range(5)), encoding="utf-8")
    command_line.main(["build", "jsonl", f"{tmp_path}/b.jsonl", f"{tmp_path}/lines", "--limit", "2"])
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/lines").collect()] == ["q0\na\n\nq1\na"]
    chats = [[{"role": "user", "content": f"u{i}"}, {"role": "assistant", "content": "answer " * 5}] for i in range(10)] + [[{"role": "user", "content": "alone"}]]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"messages": m}) + "\n" for m in chats))
    command_line.main(["pack-sft", f"{tmp_path}/c.jsonl", f"{tmp_path}/sft", "--block-size", "64", "--val-ratio", "0.2"])
    samples = {n: readers.read_packed_sft(spark, f"{tmp_path}/sft/{n}", 64).collect() for n in ("train", "val")}
    assert len(samples["train"]) > len(samples["val"]) > 0
    for r in samples["train"] + samples["val"]:
        assert r.spans and all(set(r.target_role_ids[s.begin : s.end - 1]) <= {4} for s in r.spans)


def test_sequences_of_one_chunk_need_no_map(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(numerics, "written", lambda df, name: seen.append((name, df.localCheckpoint())) or seen[-1][1])
    one = lambda x: F.array(F.lit(x))
    df = spark.range(40).select((F.col("id") % 20).alias("seq"), F.floor(F.col("id") / 20).alias("t"), F.lit(False).alias("reset"), *(one(x).alias(c) for c, x in zip("rkvwab", (1.0, 1.0, 2.0, 0.5, 0.0, 0.0), strict=True)))
    assert {(r.t, r.out[0]) for r in numerics.recurrence(df, 1).collect()} == {(0, 2.0), (1, 3.0)}
    assert sum(x.count() for name, x in seen if name == "maps") == 0
