import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("a　b c﻿d​e\r\n", "a b cde\n"),
        ("a\tb", "a\tb"),
    ],
)
def test_normalize(spark, value, wanted):
    assert one(spark, value, T.normalize) == wanted


def test_display_style(spark):
    assert one(spark, "x{\\displaystyle  y+1}z", T.unwrap_display_style) == "xy+1z"


def test_soft_wraps(spark):
    assert one(spark, "春眠不覺曉，\n處處聞啼鳥", T.join_soft_wraps) == "春眠不覺曉，處處聞啼鳥"
    assert one(spark, "abc\ndef", T.join_soft_wraps) == "abc\ndef"


@pytest.mark.parametrize("line", ["---开始阅读---", "【书名】某书", "[12]十二 回目", "| | |", "|---|---|", "12   text", "1. foo", "答："])
def test_noise(spark, line):
    assert one(spark, line, T.is_noise)
    assert one(spark, line, lambda c: F.size(T.without_noise(F.array(c)))) == 0


@pytest.mark.parametrize("line", ["---", "", "2024年", "plain text", "          12   deep"])
def test_not_noise(spark, line):
    assert not one(spark, line, T.is_noise)


@pytest.mark.parametrize(("line", "wanted"), [("|  a   |  b|", "| a | b|"), ("a    b", "a b")])
def test_padding(spark, line, wanted):
    assert one(spark, line, T.collapse_padding) == wanted


def test_clean(spark):
    assert one(spark, "\n\nA\n\n\n\nB  \n", T.clean) == "A\n\nB"
    assert one(spark, None, T.clean) is None


@pytest.mark.parametrize(("value", "wanted"), [("a" * 19, "short"), ("a" * 20, None), ("〈〉" + "a" * 20, "angle"), ("||" + "a" * 20, "pipe"), ("a!" * 20, "letters"), ("", "empty"), (None, "empty")])
def test_gates(spark, value, wanted):
    assert one(spark, value, T.gate_reason) == wanted


def test_white_space_is_pythons(spark):
    blank = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert one(spark, f"{blank}x y{blank}", T.strip) == "x y"


def test_splitlines(spark):
    value = "a\r\nb\x0bc\x85d e\n"
    assert one(spark, value, T.splitlines) == value.splitlines()


def test_soft_wraps_of_one_character(spark):
    assert one(spark, "字\n字\n字\n字", T.join_soft_wraps) == "字字\n字字"  # a character that ended one match can't begin the next
    assert one(spark, "字\n\n字\n字。\n「", T.join_soft_wraps) == "字\n\n字字。「"
    assert one(spark, "字\nA\n字", T.join_soft_wraps) == "字\nA\n字"


def test_cleaning_looks_up_no_character_alone(spark):
    plan = T.clean_rows(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "contains(" in plan.lower()
