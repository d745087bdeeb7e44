"""Texts of parallel records and of benchmark prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

# The five ways in which a pair of translations is written.
TEMPLATES = (
    "中文：{zh}\n英文：{en}",
    "{zh}\n翻译为英文是：\n{en}",
    "英文：{en}\n\n中文：{zh}",
    "{en}\n该英文翻译为中文是：\n{zh}",
    "请把下面这句中文翻译成英文：\n{zh}\n答：{en}",
)


def translation(zh: Column, en: Column, number: Column) -> Column:
    """The pair in the template that its number among accepted records falls on."""
    out = F.lit(None).cast("string")
    for k, template in enumerate(TEMPLATES):
        parts, rest = [], template
        while rest:
            at = rest.find("{")
            if at < 0:
                parts.append(F.lit(rest))
                break
            if at:
                parts.append(F.lit(rest[:at]))
            parts.append(zh if rest[at + 1] == "z" else en)
            rest = rest[at + 4 :]
        out = F.when(F.pmod(number, F.lit(len(TEMPLATES))) == k, F.concat(*parts)).otherwise(out)
    return out


def choice_prompts(shots: Column, query: Column, delimiter: Column, choices: Column) -> Column:
    """One prompt for each choice: the solved examples, then the query, the delimiter and the choice."""
    return F.transform(choices, lambda c: F.array_join(F.concat(shots, F.array(F.concat(query, delimiter, c))), "\n\n"))


def schema_prompts(shots: Column, contexts: Column, delimiter: Column, continuation: Column) -> Column:
    """One prompt for each context, all with the same continuation."""
    return F.transform(contexts, lambda c: F.array_join(F.concat(shots, F.array(F.concat(c, delimiter, continuation))), "\n\n"))


def language_prompt(shots: Column, context: Column, delimiter: Column, continuation: Column) -> tuple[Column, Column]:
    """The prompt without and with its continuation; contexts are stripped."""
    head = F.array_join(F.concat(shots, F.array(strip(context))), "\n\n")
    return head, F.concat(head, delimiter, continuation)
