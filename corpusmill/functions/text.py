"""Text cleaning and quality expressions; all are columns, in the order in which a text is cleaned.

White space is what Python's ``str.isspace`` accepts. Java 17 knows Unicode 13: characters
assigned since then count as unassigned and are removed by ``normalize``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, markers and limits of the cleaning rules.
WIDE_SPACES = "　 "
CONTROL = r"[\p{C}&&[^\n\t]]"
DISPLAY_STYLE = r"(?sU)\{\\displaystyle\s+(.+?)\}"
HAN = "㐀-鿿豈-﫿"
SOFT_WRAP = f"\n(?<=[{HAN}，。；：、！？）」』]\n)(?<!\\G\n)([{HAN}（「『])"  # a line feed first, which is rare; not right after the last match, which took the character before
BOOK_MARKERS = ("---开始阅读---", "---结束阅读---")
BOOK_PREFIXES = ("【书名】", "【作者】", "【类别】", "【状态】", "【更新】", "【本册章节】", "【简介】")
CHAPTER_TAG = r"(?U)^\[\d+\][一二三四五六七八九十百千〇零０-９0-9]+[ 　]"
EMPTY_TABLE_ROW = r"(?U)^\|(\s*\|)+\s*$"
TABLE_RULE = r"(?U)^[\s|:\-+]+$"
LINE_NUMBER = r"(?U)^\s*\d{1,5}(?:[ \t]{2,}|\.\s+)"
TEMPLATE_FRAGMENT = r"(?U)^(句中文翻译成英文：|答：|翻译为英文是：|该英文翻译为中文是：|英文：|中文：)\s*$"
MIN_LENGTH, MAX_ANGLE, MAX_PIPE, MIN_LETTERS = 20, 0.05, 0.08, 1 - 0.35
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def _replaced(c: Column, characters: str, by: str) -> Column:
    """c with each of these few characters replaced; a search of bytes, where translate looks up every character."""
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(by))
    return c


def _where(c: Column, parts: tuple[str, ...], use) -> Column:
    """use(c) where c holds one of these parts, else c: most texts need no pass of a pattern that can't match."""
    return let(c, lambda t: F.when(reduce(Column.__or__, [t.contains(x) for x in parts]), use(t)).otherwise(t))


def normalize(c: Column) -> Column:
    """Wide spaces become spaces; zero-width, control, format, private and unassigned characters go, but for line feeds and tabs."""
    return F.regexp_replace(_replaced(c, WIDE_SPACES, " "), CONTROL, "")


def unwrap_display_style(c: Column) -> Column:
    return _where(c, ("{\\displaystyle",), lambda t: F.regexp_replace(t, DISPLAY_STYLE, "$1"))


def join_soft_wraps(c: Column) -> Column:
    """Line feeds between two Han characters (or the punctuation beside them) go."""
    return _where(c, ("\n",), lambda t: F.regexp_replace(t, SOFT_WRAP, "$1"))


def _is_noise(line: Column, bare: Column) -> Column:
    ruled = bare.rlike(TABLE_RULE) & (bare.contains("|") | bare.contains("-")) & (F.length(bare) > 4)
    numbered = line.rlike(LINE_NUMBER) & (F.length(line) - F.length(lstrip(line)) < 8)
    headed = F.lit(False)
    for prefix in BOOK_PREFIXES:
        headed = headed | bare.startswith(prefix)
    found = bare.isin(*BOOK_MARKERS) | headed | bare.rlike(CHAPTER_TAG) | bare.rlike(EMPTY_TABLE_ROW) | ruled | numbered | bare.rlike(TEMPLATE_FRAGMENT)
    return (bare != "") & found


def is_noise(line: Column) -> Column:
    """Whether a line is a book marker, a table rule, a numbered line or a left-over of a template. Blank lines are not."""
    return _is_noise(line, strip(line))


def without_noise(lines: Column) -> Column:
    """The lines that aren't noise; each is stripped once."""
    pairs = F.transform(lines, lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    return F.transform(F.filter(pairs, lambda x: ~_is_noise(x["line"], x["bare"])), lambda x: x["line"])


def collapse_padding(c: Column) -> Column:
    """One blank after and before each pipe, and for each longer run of blanks; lines stay apart, so a whole text may come at once."""
    piped = _where(c, ("|",), lambda t: F.regexp_replace(F.regexp_replace(t, r"\|[ \t]+", "| "), r"[ \t]+\|", " |"))
    return _where(piped, ("  ", "\t"), lambda t: F.regexp_replace(t, r"[ \t]{2,}", " "))


def clean(c: Column) -> Column:
    """The cleaned text; null for null."""
    lines = F.split(join_soft_wraps(unwrap_display_style(normalize(c))), "\n", -1)
    kept = F.array_join(F.transform(without_noise(lines), rstrip), "\n")
    return strip(_where(collapse_padding(kept), ("\n\n\n",), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def share_of(c: Column, characters: str) -> Column:
    return (F.length(c) - F.length(_replaced(c, characters, ""))).cast("double") / F.length(c)


def letters_share(c: Column) -> Column:
    """Letters and numbers of any script, as a part of all characters."""
    return F.length(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"[^\p{L}\p{N}]+", "")).cast("double") / F.length(c)


def gate_reason(c: Column) -> Column:
    """Which quality gate a cleaned text fails first: empty, short, angle, pipe or letters; null if none."""
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.length(c) < MIN_LENGTH, "short")
        .when(share_of(c, "〈〉") > MAX_ANGLE, "angle")
        .when(share_of(c, "|") > MAX_PIPE, "pipe")
        .when(letters_share(c) < MIN_LETTERS, "letters")
    )


def clean_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text cleaned and ``reason``, the gate that it fails. A generator keeps the optimizer from working both out again in each filter."""
    both = F.transform(F.array(clean(F.col(text))), lambda t: F.struct(t.alias(text), gate_reason(t).alias("reason")))
    return df.select(*(c for c in df.columns if c != text), F.inline(both))


def code_points(c: Column) -> Column:
    """One number for each character."""
    return F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), F.ascii))


def list_sizes(lists: pa.Array) -> np.ndarray:
    """How many of ``lists.flatten()`` each list has; none where it is null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def splitlines(c: Column) -> Column:
    """Lines as Python's ``str.splitlines`` cuts them, without a last empty one."""
    return F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)


def slug(c: Column) -> Column:
    """A metric's key: runs of other characters become one underscore each, trimmed, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", ""))
