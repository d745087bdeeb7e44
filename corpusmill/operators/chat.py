"""Chat records: normalising, checking, rendering, parsing model output, and encoding for fine-tuning.

Messages are ``array<struct<role:string, content:string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import code_points, rstrip, splitlines, strip

MESSAGES = "array<struct<role:string,content:string>>"
# Roles, tags, weights and texts of the formats.
STORED_ROLES = ("user", "assistant")
ROLE_IDS = {"control": 0, "system": 1, "user": 2, "think": 3, "assistant": 4, "think_boundary": 5}
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")
TOPIC_MARK = "本次生成的对话主题是："
THINK_BLOCK, OPEN_THINK = r"(?is)<think\b[^>]*>.*?</think>", r"(?is)<think\b[^>]*>.*"
SEGMENTS = r"(?s)<think>|</think>|(?:(?!</?think>).)+"
IM_START, IM_END, EOS, PAD = 2, 3, 1, 0


def gather_messages(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation with its messages in turn order, from rows (conversation, turn, role, text)."""
    rows = turns.groupBy(conversation).agg(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", F.col("text").alias("content"))).alias("m"))
    messages = F.transform(F.sort_array("m"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(conversation, F.explode(F.array(messages)).alias("messages"))  # a generator, so that each use doesn't sort again


def message_content(value: Column) -> Column:
    """Text of a message's content as VARIANT: strings as they are, parts joined by their text or else content, null empty, anything else as JSON."""
    kind = F.schema_of_variant(value)
    parts = F.try_variant_get(value, "$", "array<variant>")
    text = lambda v, path: F.try_variant_get(v, path, "string")
    joined = F.array_join(F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", text(p, "$")).otherwise(F.coalesce(F.nullif(text(p, "$.text"), F.lit("")), text(p, "$.content"), F.lit("")))), "")
    return F.when(value.isNull() | F.is_variant_null(value), "").when(kind == "STRING", text(value, "$")).when(kind.startswith("ARRAY"), joined).otherwise(F.to_json(value))


def normalize(messages: Column) -> Column:
    """User and assistant turns only, roles stripped, null contents empty."""
    named = F.transform(messages, lambda m: F.struct(strip(F.coalesce(m["role"], F.lit(""))).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    return F.filter(named, lambda m: m["role"].isin(*STORED_ROLES))


def strict_error(messages: Column, least: int = 2, most: int = 4) -> Column:
    """Why messages aren't ``least`` to ``most`` user and assistant pairs, null if they are. The first message at fault decides."""
    n = F.size(messages)
    wanted = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    fault = lambda m, i: F.when(m.isNull(), "message is not an object").when(~m["role"].eqNullSafe(wanted(i)), F.concat(F.lit("message role must be "), wanted(i))).when(m["content"].isNull() | (strip(m["content"]) == ""), "message content is empty")
    first = F.get(F.filter(F.transform(messages, fault), lambda e: e.isNotNull()), F.lit(0))
    return (
        F.when(messages.isNull(), "messages is not a list")
        .when(n % 2 != 0, "messages must contain user/assistant pairs")
        .when((n / 2 < least) | (n / 2 > most), f"turn count must be between {least} and {most}")
        .otherwise(first)
    )


def strip_think(content: Column) -> Column:
    """content without thinking, closed or not; as it is if it has none."""
    cut = F.regexp_replace(F.regexp_replace(content, THINK_BLOCK, ""), OPEN_THINK, "")
    tidy = strip(F.regexp_replace(F.regexp_replace(cut, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return F.when(cut == content, content).otherwise(tidy)


def for_storage(messages: Column, include_think: bool = True) -> Column:
    """Normalised turns; without include_think the assistant's lose their thinking."""
    turns = normalize(messages)
    if include_think:
        return turns
    return F.transform(turns, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", strip_think(m["content"])).otherwise(m["content"]).alias("content")))


def storage_error(messages: Column) -> Column:
    """Why a normalised conversation can't be stored, null if it can."""
    answered = F.exists(messages, lambda m: (m["role"] == "assistant") & (strip(m["content"]) != ""))
    return F.when(F.size(messages) <= 0, "conversation is empty").when(~answered, "conversation has no assistant reply")


def remove_fences(text: Column) -> Column:
    """text without the lines that begin a Markdown code fence."""
    return strip(F.array_join(F.filter(splitlines(F.coalesce(text, F.lit(""))), lambda x: ~strip(x).startswith("```")), "\n"))


def judge_output(df: DataFrame, text: str = "text", least: int = 2, most: int = 4) -> DataFrame:
    """(index, messages, error) of the records and faults in a model's output beside df's other columns, error null for what is right; df is read once."""
    keep = [c for c in df.columns if c != text]
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator, so that each use doesn't work it out again
    clean = df.select(*keep, once(remove_fences(F.col(text))).alias("_t"))
    array = F.when(F.col("_t").startswith("["), F.from_json("_t", "array<string>"))
    lines = F.filter(F.transform(splitlines(F.col("_t")), lambda x, i: F.struct(strip(x).alias("line"), (i + 1).alias("at"))), lambda x: x["line"] != "")
    parsed = clean.withColumn("_array", once(array)).withColumn("_lines", once(F.when(F.coalesce(F.size("_array"), F.lit(0)) <= 0, lines)))
    item = lambda at, record, error: F.struct(at.cast("int").alias("index"), record.alias("_r"), error.alias("_e"))
    none = F.lit(None).cast("string")
    good = F.coalesce("_array", F.transform(F.filter("_lines", lambda x: F.try_parse_json(x["line"]).isNotNull()), lambda x: x["line"]))
    bad = F.filter("_lines", lambda x: F.try_parse_json(x["line"]).isNull())
    found = F.array(
        F.transform(good, lambda r, i: item(i + 1, r, none)),
        F.transform(bad, lambda x: item(x["at"], none, F.concat(F.lit("line "), x["at"], F.lit(": invalid JSON")))),
        F.when(F.col("_t") == "", F.array(item(F.lit(0), none, F.lit("empty output")))),
        F.when(F.col("_t").startswith("[") & F.try_parse_json("_t").isNull(), F.array(item(F.lit(0), none, F.lit("invalid JSON array")))),
    )
    items = parsed.select(*keep, F.inline(F.flatten(F.filter(found, lambda x: x.isNotNull()))))
    records = items.withColumn("messages", once(F.from_json("_r", f"struct<messages:{MESSAGES}>")["messages"]))
    fault = F.when(~F.coalesce(F.col("_r").rlike(r"^\s*\{"), F.lit(False)), "record is not an object").otherwise(strict_error(F.col("messages"), least, most))
    return records.select(*keep, "index", "messages", F.coalesce("_e", F.concat(F.lit("record "), F.col("index"), F.lit(": "), fault)).alias("error"))


def parse_output(df: DataFrame, text: str = "text", least: int = 2, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations and errors in a model's output: (index, messages) and (index, error) beside df's other columns.

    The output is a JSON array of records or one record on each line, perhaps in a code fence.
    """
    judged = judge_output(df, text, least, most)
    return judged.where("error is null").drop("error"), judged.where("error is not null").drop("messages")


def render(messages: Column, prompt: bool = False) -> Column:
    """<im_start>role, line feed, content, <im_end>, line feed for each message; with prompt also the start of an answer."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<im_start>"), m["role"], F.lit("\n"), m["content"], F.lit("<im_end>\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<im_start>assistant\n")) if prompt else text


def render_topic(template: Column, topic: Column) -> Column:
    """The topic in the template's {topic}, or after its marker, or added at the end."""
    t, x = strip(F.coalesce(template, F.lit(""))), strip(F.coalesce(topic, F.lit("")))
    marked = TOPIC_MARK + "主题"
    return F.when(t.contains("{topic}"), F.replace(t, F.lit("{topic}"), x)).when(t.contains(marked), F.replace(t, F.lit(marked), F.concat(F.lit(TOPIC_MARK), x))).otherwise(strip(F.concat(t, F.lit("\n\n" + TOPIC_MARK), x)))


def single_turn(prompt: Column, answer: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("user", prompt), message("assistant", answer))


def api_messages(messages: Column, system: Column) -> Column:
    """The stripped system prompt, if any, then the normalised turns."""
    text = strip(F.coalesce(system, F.lit("")))
    head = F.when(text != "", F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))).otherwise(F.array().cast(MESSAGES))
    return F.concat(head, normalize(messages))


def wrap_reasoning(content: Column, reasoning: Column) -> Column:
    """The reasoning in a thinking block before the content, unless the content has one."""
    c, r = F.coalesce(content, F.lit("")), strip(F.coalesce(reasoning, F.lit("")))
    return F.when((r != "") & ~c.contains("<think>"), rstrip(F.concat(F.lit("<think>"), r, F.lit("</think>\n"), c))).otherwise(c)


def undo_last_turn(messages: Column) -> Column:
    """messages up to, but without, the last user turn; none if there is no user turn."""
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    return F.slice(messages, F.lit(1), F.coalesce(F.array_max(users), F.lit(0)))


def parse_list(text: Column) -> Column:
    """Distinct stripped items, in order, of a list separated by commas or line feeds."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n]"), strip), lambda x: x != ""))


def parse_values(text: Column, kind: str) -> Column:
    """A comma-separated list as an array of ``kind``; a list without items, or with another kind of item, fails the query."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, items.cast(f"array<{kind}>")).otherwise(F.raise_error(F.lit("the list is empty")))


def parse_lines(text: Column) -> Column:
    return F.filter(F.transform(splitlines(F.coalesce(text, F.lit(""))), strip), lambda x: x != "")


def parse_stop(text: Column) -> Column:
    """The stop strings, null if none."""
    found = parse_lines(text)
    return F.when(F.size(found) > 0, found)


def is_host(url: Column, host: str) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(strip(url), F.lit("HOST"))) == host, F.lit(False))


def reasoning_effort(value: Column) -> Column:
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*EFFORTS), v).otherwise("")


def repository_of(url: Column) -> Column:
    """The first two parts of a hub address's path; names that aren't addresses stay."""
    path = F.split(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", ""), "/")
    return F.when(url.rlike("^https?://"), F.array_join(F.slice(path, 1, 2), "/")).otherwise(url)


_TOKEN = "array<struct<tok:int,w:double,role:int>>"


def _tokens(ids: Column, weight: float | Column, role: Column) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.transform(ids, lambda t: F.struct(t.cast("int").alias("tok"), w.cast("double").alias("w"), role.cast("int").alias("role"))).cast(_TOKEN)


def _assistant(content: Column, think_weight: float, boundary_weight: float) -> Column:
    """Tokens of an answer: tags, thinking and answer text each with its weight and role. The tags are one token each, 4 and 5."""
    parts = F.regexp_extract_all(content, F.lit(SEGMENTS), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        opens, closes = x == "<think>", x == "</think>"
        tag = _tokens(F.array(F.when(opens, F.lit(4)).otherwise(F.lit(5))), boundary_weight, F.lit(ROLE_IDS["think_boundary"]))
        inside = acc["inside"]
        text = _tokens(code_points(x), F.when(inside, think_weight).otherwise(1.0), F.when(inside, ROLE_IDS["think"]).otherwise(ROLE_IDS["assistant"]))
        state = F.when(opens, True).when(closes, False).otherwise(inside)
        return F.struct(state.alias("inside"), F.concat(acc["out"], F.when(opens | closes, tag).otherwise(text)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(False).alias("inside"), F.array().cast(_TOKEN).alias("out")), add, lambda acc: acc["out"])


def encode_sft(messages: Column, think_weight: float = 0.1, boundary_weight: float = 1.0) -> Column:
    """array of (tok, w, role): im_start, role and line feed, content, im_end and line feed of each message, then the end token.

    Tokens are code points, with 0 to 5 for padding, end, message marks and thinking tags. Only
    answers, their end marks and the end token have a weight.
    """
    control = F.lit(ROLE_IDS["control"])

    def one(m: Column) -> Column:
        role = F.lit(ROLE_IDS["control"])
        for name in ("system", "user"):
            role = F.when(m["role"] == name, ROLE_IDS[name]).otherwise(role)
        answer = m["role"] == "assistant"
        head = _tokens(F.concat(F.array(F.lit(IM_START)), code_points(F.concat(m["role"], F.lit("\n")))), 0.0, control)
        body = F.when(answer, _assistant(m["content"], think_weight, boundary_weight)).otherwise(_tokens(code_points(m["content"]), 0.0, role))
        tail = F.concat(_tokens(F.array(F.lit(IM_END)), F.when(answer, 1.0).otherwise(0.0), control), _tokens(F.array(F.lit(10)), 0.0, control))
        return F.concat(head, body, tail)

    return F.concat(F.flatten(F.transform(messages, one)), _tokens(F.array(F.lit(EOS)), 1.0, control))


def answer_spans(encoded: Column, least: int = 3) -> Column:
    """Runs [begin, end) of at least ``least`` answer tokens, thinking and marks apart. Each edge is told by a token and its neighbour."""
    answer = lambda i: F.coalesce(F.get(encoded, i)["role"] == ROLE_IDS["assistant"], F.lit(False))
    edges = lambda other: F.filter(F.transform(encoded, lambda t, i: F.when((t["role"] == ROLE_IDS["assistant"]) & ~answer(other(i)), i)), lambda i: i.isNotNull())
    runs = F.zip_with(edges(lambda i: i - 1), edges(lambda i: i + 1), lambda b, e: F.struct(b.alias("begin"), (e + 1).alias("end")))
    return F.filter(runs, lambda s: s["end"] - s["begin"] >= least)


def padded(encoded: Column, block: int) -> tuple[Column, Column, Column]:
    """One record alone in a block: inputs, labels and mask. Labels past the record are -100, by position."""
    filled = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), block - F.size(c)))
    tokens, weights = encoded["tok"], encoded["w"]
    return filled(F.slice(tokens, 1, block), EOS), filled(F.slice(tokens, 2, block), -100), filled(F.slice(weights, 2, block), 0.0)
