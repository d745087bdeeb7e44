import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chat
from corpusmill.plans import sequence_queries as q
from tests.compare import same


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def messages(*pairs):
    return F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in pairs))


def plain(rows):
    return [(r.role, r.content) for r in rows]


def test_parsers(spark):
    assert value(spark, chat.parse_list(F.lit(" a, b,\na, ,c "))) == ["a", "b", "c"]
    assert value(spark, chat.parse_lines(F.lit(" a \n\n b\n  "))) == ["a", "b"]
    assert value(spark, chat.parse_stop(F.lit(""))) is None
    assert value(spark, chat.parse_stop(F.lit("END\nSTOP"))) == ["END", "STOP"]
    assert value(spark, chat.reasoning_effort(F.lit(" XHIGH "))) == "xhigh"
    assert value(spark, chat.reasoning_effort(F.lit("default"))) == ""
    assert value(spark, chat.is_host(F.lit("https://example.org/api/v1"), "example.org"))
    assert not value(spark, chat.is_host(F.lit("https://api.example.com/v1"), "example.org"))
    assert value(spark, chat.repository_of(F.lit("https://hub.example.org/org/name/tree/main"))) == "org/name"


def test_topics(spark):
    mark = chat.TOPIC_MARK
    assert value(spark, chat.render_topic(F.lit(f"编写数据\n{mark}主题"), F.lit("茶道"))) == f"编写数据\n{mark}茶道"
    assert value(spark, chat.render_topic(F.lit("topic={topic}"), F.lit("琴谱"))) == "topic=琴谱"
    assert value(spark, chat.render_topic(F.lit(None).cast("string"), F.lit("x"))) == f"{mark}x"


def test_builders(spark):
    turns = messages(("user", "hi"), ("assistant", "hello"))
    assert plain(value(spark, chat.api_messages(turns, F.lit(" be concise ")))) == [("system", "be concise"), ("user", "hi"), ("assistant", "hello")]
    assert plain(value(spark, chat.single_turn(F.lit("p"), F.lit("a")))) == [("user", "p"), ("assistant", "a")]
    assert value(spark, chat.wrap_reasoning(F.lit("answer"), F.lit("reason"))) == "<think>reason</think>\nanswer"
    assert value(spark, chat.wrap_reasoning(F.lit("<think>x</think>a"), F.lit("reason"))) == "<think>x</think>a"
    assert value(spark, chat.remove_fences(F.lit("```jsonl\n{}\n```"))) == "{}"


@pytest.mark.parametrize(
    ("pairs", "wanted"),
    [
        ([("user", "a"), ("assistant", "b")] * 2, None),
        ([("system", "a"), ("assistant", "b")] * 2, "message role must be user"),
        ([("user", "a"), ("assistant", " ")] * 2, "message content is empty"),
        ([("user", "a")], "messages must contain user/assistant pairs"),
        ([("user", "a"), ("assistant", "b")], "turn count must be between 2 and 4"),
    ],
)
def test_strict(spark, pairs, wanted):
    assert value(spark, chat.strict_error(messages(*pairs))) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("<think>reason</think>\nanswer", "answer"), ("<think>a</think>\nanswer\n<think>b</think>", "answer"), ("x <THINK y> open", "x"), ("no\n\n\n\nthought ", "no\n\n\n\nthought ")])
def test_strip_think(spark, text, wanted):
    assert value(spark, chat.strip_think(F.lit(text))) == wanted


def test_storage(spark):
    turns = messages(("system", "s"), ("user", "<think>keep</think> question"), ("assistant", "<think>drop</think> answer"))
    assert plain(value(spark, chat.for_storage(turns, include_think=False))) == [("user", "<think>keep</think> question"), ("assistant", "answer")]
    assert value(spark, chat.storage_error(messages(("user", "a")))) == "conversation has no assistant reply"


def test_parse_output(spark):
    record = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"},{"role":"user","content":"c"},{"role":"assistant","content":"d"}]}'
    df = spark.createDataFrame([(1, f"```jsonl\nnot json\n{record}\n```"), (2, f"[{record}]"), (3, "")], "id int, text string")
    good, errors = chat.parse_output(df)
    assert sorted((r.id, len(r.messages)) for r in good.collect()) == [(1, 4), (2, 4)]
    assert sorted((r.id, r.error) for r in errors.collect()) == [(1, "line 1: invalid JSON"), (3, "empty output")]


def test_content_parts(spark):
    df = spark.createDataFrame([('"x"',), ('[{"text":"a"},{"content":"b"},"c"]',), ("null",), ("3",)], "j string")
    assert [r[0] for r in df.select(chat.message_content(F.parse_json("j"))).collect()] == ["x", "abc", "", "3"]


def test_encoding(spark):
    turns = messages(("system", "S"), ("user", "U"), ("assistant", "<think>abc</think>xyz"))
    e = value(spark, chat.encode_sft(turns))
    weights = {}
    for t in e:
        weights.setdefault(t.role, set()).add(t.w)
    assert weights[1] == {0.0} and weights[2] == {0.0} and weights[3] == {0.1} and weights[5] == {1.0} and weights[4] == {1.0}
    assert [t.w for t in e if t.tok == 3] == [0.0, 0.0, 1.0] and e[-1].w == 1.0
    spans = value(spark, chat.answer_spans(chat.encode_sft(turns)))
    assert [(s.end - s.begin) for s in spans] == [3] and all(e[i].role == 4 for i in range(spans[0].begin, spans[0].end))


def test_padding_by_position(spark):
    e = F.array(*(F.struct(F.lit(t).alias("tok"), F.lit(w).alias("w"), F.lit(0).alias("role")) for t, w in ((10, 0.0), (20, 1.0), (1, 1.0))))
    ids, labels, mask = chat.padded(e, 5)
    assert value(spark, ids) == [10, 20, 1, 1, 1]
    assert value(spark, labels) == [20, 1, -100, -100, -100]
    assert value(spark, mask) == [1, 1, 0, 0, 0]


def test_undo(spark):
    assert plain(value(spark, chat.undo_last_turn(messages(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))))) == [("user", "a"), ("assistant", "b")]


def test_a_models_output_is_read_once(spark, tmp_path):
    """Records and faults come from one scan; each kind had its own before."""
    spark.createDataFrame([(1, "no json\n[1"), (2, "")], "id int, text string").write.parquet(f"{tmp_path}/o")
    judged = chat.judge_output(spark.read.parquet(f"{tmp_path}/o"))
    assert judged._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {(r["id"], r["index"], r["error"]) for r in judged.collect()} == {(1, 1, "line 1: invalid JSON"), (1, 2, "line 2: invalid JSON"), (2, 0, "empty output")}


def test_records_as_long_as_a_block_are_padded_as_in_sql(spark, tmp_path):
    """The query failed: a Python function over labels cut inside nested lambdas was never taken out of its projection."""
    rows = [(n, t, r, c) for n in (0, 1, *range(229, 241), 600) for t, (r, c) in enumerate((("user", "q"), ("assistant", "é" * n)))]  # 256 tokens at 233
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/made")
    made = pq.read_table(f"{tmp_path}/made")
    pq.write_table(made, f"{tmp_path}/conversations.parquet")
    same(q.unpacked_padding(spark, str(tmp_path)), str(tmp_path), q.UNPACKED)
