import json
import random
import re
import time

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.plans import stream_queries
from corpusmill.sources import readers, sinks
from corpusmill.streaming import feeds


def texts(df):
    return [r.text for r in df.orderBy("source", "row_idx").collect()]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(bytes.fromhex("C4E3BAC3"))
    (tmp_path / "b.txt").write_text("héllo\nworld", encoding="utf-8")
    (tmp_path / ".DS_Store").write_text("x")
    assert texts(readers.read_text_files(spark, str(tmp_path))) == ["你好", "héllo\nworld"]
    assert "�" in texts(readers.read_text_files(spark, str(tmp_path), replace=True))[0]
    assert [r.name for r in readers.list_files(spark, str(tmp_path)).collect()] == ["a.txt", "b.txt"]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    assert [(r.text, r.row_idx) for r in readers.read_lines(spark, str(tmp_path)).collect()] == [("x", 0), ("y", 2)]


def test_parquet_kinds(spark, tmp_path):
    spark.createDataFrame([("a",), ("",), (None,)], "TEXT string").coalesce(1).write.parquet(f"{tmp_path}/1")
    assert texts(readers.read_parquet_text(spark, f"{tmp_path}/1")) == ["a"]
    spark.createDataFrame([("en", "ch"), ("x", None), ("", "y")], "en string, ch string").coalesce(1).write.parquet(f"{tmp_path}/2")
    assert texts(readers.read_parquet_text(spark, f"{tmp_path}/2")) == ["中文：ch\n英文：en", "y\n翻译为英文是：\n"]
    spark.createDataFrame([("o", "t"), ("o", None)], "og_full_text string, translated_text string").coalesce(1).write.parquet(f"{tmp_path}/3")
    assert texts(readers.read_parquet_text(spark, f"{tmp_path}/3")) == ["中文：t\n英文：o", "o"]
    spark.range(1).write.parquet(f"{tmp_path}/4")
    with pytest.raises(ValueError, match="no known text column"):
        readers.read_parquet_text(spark, f"{tmp_path}/4")


def test_jsonl_kinds(spark, tmp_path):
    files = {
        "a": ['{"zh_text":"一","en_text":"one"}', "bad", '{"en_text":"only"}', '{"zh_text":"二","en_text":""}'],
        "b": ['{"段落":[{"内容":"x"},{"内容":""},{"内容":"y"}]}'],
        "c": ['{"主题":"t","回复":[{"回复":"r1"},{"回复":"r2"}]}'],
        "d": ['{"instruction":"i","input":"","output":"o"}', '{"instruction":"i","input":"n","output":"o"}'],
        "e": ['{"问":"q","答":"a"}'],
        "f": ['{"other":1}', '{"问":"q","答":"a"}'],
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")
    assert texts(readers.read_jsonl_text(spark, str(tmp_path))) == ["中文：一\n英文：one", "二", "x\ny", "t\n\nr1\nr2", "i\no", "i\nn\no", "q\na"]


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"completion": "c"}, {"query": "q", "thought": "t", "answer": "a", "source": "s"}, {"text": "x"}, {"content": "y"}]))
    (tmp_path / "b.json").write_text('{"text": "no array"}')
    got = {(r.text, r.source) for r in readers.read_json_arrays(spark, str(tmp_path)).collect()}
    assert got == {("c", "a.json"), ("q\nt\na", "s"), ("x", "a.json"), ("y", "a.json")}


def test_chat_lines_are_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages":[{"role":"assistant","content":"a"}]}\n\n{"messages":[]}\n')
    assert [r.at for r in readers.read_chat_jsonl(spark, f"{tmp_path}/a.jsonl").collect()] == [0, 2]
    (tmp_path / "b.jsonl").write_text('{"messages":[]}\nnope\n')
    with pytest.raises(Exception, match="line 2: invalid JSON"):
        readers.read_chat_jsonl(spark, f"{tmp_path}/b.jsonl").collect()
    assert readers.read_chat_jsonl(spark, f"{tmp_path}/b.jsonl", most=1).count() == 1


def test_packed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([10, 11, 1, 20, 21, 1, 30], [0, 0, 0, 1, 1, 1, 2], [0, 1, 2, 0, 1, 2, 0], [True] * 7)], "token_ids array<int>, seq_ids array<int>, position_ids array<int>, sequence_starts array<boolean>")
    sinks.write_packed(df, f"{tmp_path}/p", 6, tokenizer="code points")
    assert readers.read_packed(spark, f"{tmp_path}/p", 6).count() == 1
    assert readers.read_manifest(spark, f"{tmp_path}/p")["tokenizer"] == "code points"
    with pytest.raises(ValueError, match="block_size=6"):
        readers.read_packed(spark, f"{tmp_path}/p", 5)
    with pytest.raises(Exception, match="6 tokens long"):
        sinks.write_packed(df, f"{tmp_path}/q", 5)
    assert readers.detect_format(df) == "packed" and readers.detect_format(spark.range(1)) == "text"
    with pytest.raises(ValueError):
        readers.detect_format(spark.range(1), "packed")


def test_jsonl_append(spark, tmp_path):
    df = spark.createDataFrame([("你好", float("inf"))], "text string, x double")
    sinks.append_jsonl(df.coalesce(1), f"{tmp_path}/j")
    sinks.append_jsonl(df.coalesce(1), f"{tmp_path}/j")
    assert [r.value for r in spark.read.text(f"{tmp_path}/j").collect()] == ['{"text":"你好","x":null}'] * 2
    assert sinks.write_verified(df, f"{tmp_path}/v") == 1


def test_bundle(spark, tmp_path):
    (tmp_path / "eval_data").mkdir()
    (tmp_path / "eval_data/toy.jsonl").write_text('{"query":"q","choices":["x","y"],"gold":0}\n')
    (tmp_path / "eval_meta_data.csv").write_text("Eval Task,Random baseline\ntoy_mc,50\nblank,\n")
    tasks, base, items = readers.read_bundle(spark, str(tmp_path), [{"label": "toy_mc", "icl_task_type": "multiple_choice", "dataset_uri": "toy.jsonl"}])
    assert tasks.count() == 1 and [tuple(r) for r in base.collect()] == [("toy_mc", 50.0)] and items.first().task == "toy_mc"


def test_synthetic_batches(spark):
    for r in readers.synthetic_batches(spark, 3, 20, 100, 6).collect():
        assert len(r.token_ids) == len(r.seq_ids) == 20 and min(r.token_ids) >= 4 and max(r.token_ids) < 100
        assert all((p == 0) == (i == 0 or r.seq_ids[i] != r.seq_ids[i - 1]) for i, p in enumerate(r.position_ids))


def run(stream, tmp_path, name):
    return feeds.run_available(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/cp-{name}")


def test_feeds(spark, tmp_path):
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat/a.json").write_text('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"<think>x</think>b"}]}\n{"messages":[{"role":"user","content":"a"}]}\n')
    got = run(feeds.chat_feed(spark, f"{tmp_path}/chat"), tmp_path, "chats")[0].collect()
    assert [[(m.role, m.content) for m in r.messages] for r in got] == [[("user", "a"), ("assistant", "b")]]
    spark.createDataFrame([("plain words repeated here", "s")] * 2, "text string, source string").withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("text string, source string, ts timestamp").parquet(f"{tmp_path}/docs")
    assert run(feeds.clean_feed(stream), tmp_path, "cleans")[0].count() == 1


def test_dedup_state_has_few_partitions(spark, tmp_path, monkeypatch):
    """Each partition of state costs about as much as a few MB of texts in every batch."""
    monkeypatch.setattr(sinks, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream_queries.stream_dedup(spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "stream-cleaned-state/state/0").iterdir() if p.name.isdigit()]) == 16


def plain_windows(rows, count, block):
    out = {}
    for shard in range(count):
        stream = [x for r, ids in sorted(rows) if r % count == shard for x in ids or []]
        out |= {(shard, k): stream[k * block : (k + 1) * block + 1] for k in range(max(0, len(stream) - 1) // block)}
    return out


TOKENS = "row_idx long, tokens array<int>"


def test_packing_waits_for_rows_and_restarts(spark, tmp_path):
    """Rows arrive out of order over several micro-batches; a run stops after some files and the next one goes on."""
    rng = random.Random(4)
    rows = [(r, [rng.randrange(100) for _ in range(rng.randrange(9))] if r % 11 else None) for r in range(120)]
    order = rng.sample(rows, len(rows))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def add(part):
        spark.createDataFrame(part, TOKENS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tokens")

    def packed():
        stream = spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tokens")
        found, batches = run(feeds.pack_feed(stream, 5, 2), tmp_path, "packs")
        return [((r.shard, r.window), r.token_ids) for r in found.collect()], batches

    for k in range(3):
        add(order[k * 25 : (k + 1) * 25])
    first, batches = packed()
    assert batches == 3
    for k in range(3, 5):
        add(order[k * 25 : (k + 1) * 25])
    second, batches = packed()
    wanted = plain_windows(rows, 2, 5)
    assert batches == 2 and dict(second) == wanted and len(second) == len(wanted)
    assert set(map(repr, first)) < set(map(repr, second))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_packing_goes_on_without_a_row_after_a_while(spark, tmp_path):
    rows = [(r, [r, r]) for r in range(6) if r != 2]
    spark.createDataFrame(rows, TOKENS).coalesce(1).write.parquet(f"{tmp_path}/tokens")
    stream = spark.readStream.schema(TOKENS).parquet(f"{tmp_path}/tokens")
    with feeds.state_store(spark):
        query = feeds.pack_feed(stream, 2, 1, patience=1).writeStream.format("memory").queryName("patient").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            found = {r.window: r.token_ids for r in spark.table("patient").collect()}
            if len(found) == 4:
                break
    finally:
        query.stop()
    assert found == {0: [0, 0, 1], 1: [1, 1, 3], 2: [3, 3, 4], 3: [4, 4, 5]}


class Puts(dict):
    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def getValue(self, k):  # noqa: N802
        return self[k]


def test_waiting_ids_take_few_bytes_and_come_back():
    """They took four bytes each; a stream of texts gives the ids of arrays."""
    text = "words of a text, and é€😀 " * 4000
    ids = np.frombuffer(text.encode("utf-32-le"), np.int32)
    for x in (ids, -ids, ids[:0], np.array([-1, 2**31 - 1, -(2**31)], np.int32)):
        assert (feeds._unsqueezed(feeds._squeezed(x), len(x)) == x).all()
    states = []
    for tokens in (text, ids.tolist()):
        packer = feeds._Packer(4, 2, None)
        packer.waiting, packer.pieces = Puts(), np.empty((0, 3), np.int64)
        packer._wait([5, 7, 9], [feeds._ids(tokens), feeds._ids(None), feeds._ids("")])
        states.append(packer.waiting)
        back = packer._piece(0)
        assert list(back) == [5, 7, 9] and (back[5] == ids).all() and not len(back[7]) and not len(back[9])
    assert states[0] == states[1] and sum(map(len, states[0][(0,)])) < len(ids)


def test_a_stream_of_texts_packs_as_one_of_ids(spark, tmp_path):
    texts = ["ab\x01", "", None, "x", "é€😀\x00" * 40, "long" * 300, *("w" * k for k in range(30))]
    rows = [(r, t) for r, t in enumerate(texts)]
    schema, found = "row_idx long, text string", []
    spark.createDataFrame(rows[::-1], schema).repartition(3).write.parquet(f"{tmp_path}/texts")
    for k, tokens in enumerate((F.col("text"), F.expr("transform(split(text, ''), c -> ascii(c))"))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/texts")
        packed, _ = run(feeds.pack_feed(stream.select("row_idx", F.when(F.col("text") != "", tokens).alias("tokens")), 5, 2), tmp_path, f"texts{k}")
        found.append(sorted(map(repr, packed.collect())))
    assert found[0] == found[1] and len(found[0]) > 300


def test_a_stream_leaves_no_shuffle_files(spark, tmp_path):
    """They stayed until the driver collected its memory, those of all batches at once."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().toString()))
    spark.createDataFrame([(r, "text") for r in range(100)], "row_idx long, tokens string").repartition(4).write.parquet(f"{tmp_path}/texts")
    before = files()
    stream = spark.readStream.schema("row_idx long, tokens string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/texts")
    _, batches = run(feeds.pack_feed(stream, 5, 2), tmp_path, "removed")
    for _ in range(40):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.5)
    assert batches == 4 and not files() - before


def test_waiting_rows_cost_few_accesses_to_the_state():
    class State(dict):
        puts = 0

        def exists(self):
            return "v" in self

        def get(self):
            return self["v"]

        def update(self, v):
            self["v"] = v

        def updateValue(self, k, v):  # noqa: N802
            self.puts += 1
            self[k] = v

        def getValue(self, k):  # noqa: N802
            return self[k]

        def removeKey(self, k):  # noqa: N802
            del self[k]

    packer = feeds._Packer(4, 2, None)
    packer.place, packer.waiting = State(), State()
    rows = list(range(1, 2001, 2))
    found = []
    for part in (rows[1::2], rows[::2]):  # every other row first: all of them wait
        for frame in packer._packed((1,), iter([pd.DataFrame({"row_idx": part[::-1], "tokens": [[r, r] for r in part[::-1]]})]), None):
            found += frame["token_ids"].tolist()
    stream = [r for r in rows for _ in (0, 1)]
    assert [list(x) for x in found] == [stream[a : a + 5] for a in range(0, len(stream) - 4, 4)]
    assert packer.waiting.puts <= 4 and not dict(packer.waiting)
