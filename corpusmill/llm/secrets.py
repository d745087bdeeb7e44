"""Secrets in text: three fixed patterns, and strings that look random to character Markov models.

Everything is a DataFrame expression. A pattern's matches and the pieces of text between them
come from one regular expression each, and the running sum of their lengths gives the matches'
places in code points.

The models are first-order: one of random strings (hex, base64, capitals and digits), one of
ordinary identifiers (words of the corpus, joined in the usual ways). Both are counted on
labelled samples, with one added to each count. A run of 20 or more characters of the alphabet
is a secret if its log-likelihood ratio exceeds the threshold, in all and for each character;
what a fixed pattern finds is taken out of the run first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import free_name

# The patterns that every scan has, and the characters of candidate runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
MARK = "[secret]"


@dataclass(frozen=True)
class Model:
    """log P(next | this, random) - log P(next | this, identifier), row by row of the alphabet."""

    ratios: tuple[float, ...]
    least_total: float = 8.0
    least_mean: float = 0.35


def bound(x: Column, use) -> Column:
    """use(x), with x worked out once."""
    return F.transform(F.array(x), use)[0]


def sums_before(numbers: Column, chunk: int = 128) -> Column:
    """For each of an array of longs the sum of those before it. Sums go over chunks first, so the work hardly grows faster than the array."""

    def inside(own: Column, base: Column) -> Column:
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(own, F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out")), add, lambda acc: acc["out"])

    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda own: F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
        bases = bound(totals, lambda t: F.transform(t, lambda x, k: F.aggregate(F.slice(t, F.lit(1), k), F.lit(0).cast("bigint"), lambda acc, y: acc + y)))
        return F.flatten(F.zip_with(parts, bases, inside))

    parts = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / chunk).cast("int")), lambda k: F.slice(n, k * chunk + 1, F.lit(chunk)))
    return F.when(F.size(numbers) > 0, bound(bound(numbers, parts), over)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, value), in code points, of the leftmost non-overlapping matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    size = lambda x: F.length(x).cast("bigint")
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, before: F.struct(m.alias("m"), size(before).alias("gap"), size(m).alias("size")))
    place = lambda x, before: F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["size"]).alias("end"), x["m"].alias("value"))
    every = bound(pairs, lambda p: F.zip_with(p, sums_before(F.transform(p, lambda x: x["gap"] + x["size"])), place))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def _as_spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))).cast(_SPAN)


def log_ratio(run: Column, model: Model) -> Column:
    """Sum of the model's ratios over the character pairs of a run of the alphabet."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model.ratios)), ",").cast("array<double>")
    chars, n = F.split(run, ""), F.length(run)
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.get(table, (place(a) - 1) * len(ALPHABET) + place(b) - 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _is_random(run: Column, model: Model) -> Column:
    return bound(log_ratio(run, model), lambda total: (total > model.least_total) & (total > model.least_mean * (F.length(run) - 1)))


def labelled_samples(docs: DataFrame, sample_rows: int, random_rows: int) -> DataFrame:
    """(value, random): random strings made from hashes, and identifiers made of all neighbouring words of about sample_rows documents."""
    spark = docs.sparkSession
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    size = F.pmod(F.xxhash64("id"), F.lit(21)) + 20
    base64 = F.base64(F.unhex(F.concat(digest("a"), digest("b"))))
    kinds = F.pmod(F.col("id"), F.lit(3))
    string = F.when(kinds == 0, digest("c")).when(kinds == 1, base64).otherwise(F.regexp_replace(F.upper(base64), "[^A-Z0-9]", ""))
    random = spark.range(random_rows).select(F.substring(string, F.lit(1), size.cast("int")).alias("value"), F.lit(True).alias("random"))
    every = max(1, docs.count() // sample_rows)
    words = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), F.lit(0)).alias("w"))
    after = [F.slice("w", F.lit(k), F.size("w")).alias(f"w{k}") for k in (1, 2, 3)]
    three = words.where(F.size("w") >= 3).select(F.posexplode(F.arrays_zip(*after)).alias("i", "p")).select("i", F.array_compact(F.array("p.w1", "p.w2", "p.w3")).alias("w"))
    lower, way = F.transform("w", F.lower), F.pmod(F.xxhash64("w", "i"), F.lit(7))
    two = lambda n: F.lpad((F.pmod("i", F.lit(n)) + 1).cast("string"), 2, "0")
    dated = F.concat_ws("-", (F.pmod("i", F.lit(40)) + 1990).cast("string"), two(12), two(28), two(24), F.element_at(lower, 1))
    joined = F.when(way == 6, dated).when(way == 0, F.array_join(lower, "_")).when(way == 1, F.array_join(lower, "-")).when(way == 2, F.array_join(lower, "/")).when(way == 3, F.array_join(F.transform("w", F.initcap), "")).when(way == 4, F.upper(F.array_join("w", "_"))).otherwise(F.concat(F.array_join(lower, ""), F.pmod(F.col("i"), F.lit(100)).cast("string")))
    return random.union(three.select(joined.alias("value"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> Model:
    """Count character pairs of labelled samples (value, random); at most two counts for each pair reach the driver."""
    k = len(ALPHABET)
    chars = samples.select("random", F.split("value", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    at = pairs.select("random", F.instr(F.lit(ALPHABET), F.col("p.a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b")).where("a > 0 and b > 0")
    counts = {(r["random"], r["a"] - 1, r["b"] - 1): r["count"] for r in at.groupBy("random", "a", "b").count().collect()}
    ratios = []
    for a in range(k):
        totals = {kind: sum(counts.get((kind, a, b), 0) + 1 for b in range(k)) for kind in (True, False)}
        ratios += [math.log((counts.get((True, a, b), 0) + 1) / totals[True]) - math.log((counts.get((False, a, b), 0) + 1) / totals[False]) for b in range(k)]
    return Model(tuple(ratios))


def _outside(run: Column, spans: Column) -> Column:
    """The parts of a run (start, end, value) outside of spans (by start), of 20 or more characters."""
    meets = F.filter(spans, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substring(run["value"], (a - run["start"] + 1).cast("int"), (b - a).cast("int")).alias("value"))
    none = "array<struct<start:bigint,end:bigint,value:string>>"

    def add(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(part(acc["at"], b["start"]))).alias("out"))

    parts = F.aggregate(meets, F.struct(run["start"].alias("at"), F.array().cast(none).alias("out")), add, lambda acc: F.concat(acc["out"], F.array(part(acc["at"], run["end"]))))
    return F.when(F.size(meets) == 0, F.array(run)).otherwise(F.filter(parts, lambda x: x["end"] - x["start"] >= 20))


def find_secrets(docs: DataFrame, model: Model, name: str = "spans") -> DataFrame:
    """docs with a column ``name``: array of (start, rank, end, kind) by start and rank, in code points, ends exclusive.

    The kinds assign, access and hex follow the fixed patterns and may overlap; random is the
    model's, for what lies of a run outside of the other kinds. Null and empty texts have no
    spans; texts of any length are scanned whole. Repeated rows, and rows without a doc_id, are
    scanned alike, each on its own. The text and the other columns stay as they are, but for
    one that has the result's name, which is replaced. An empty table gives an empty result.
    """
    text, base = F.coalesce(F.col("text").cast("string"), F.lit("")), free_name(docs, "_base")
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    found = docs.withColumn(base, F.array_sort(F.concat(_as_spans(assign, "assign"), _as_spans(matches(text, ACCESS), "access"), _as_spans(matches(text, HEX), "hex"))))
    parts = F.flatten(F.transform(matches(text, RUN), lambda s: _outside(s, F.col(base))))
    runs = F.filter(parts, lambda s: _is_random(s["value"], model))
    return found.withColumn(name, F.array_sort(F.concat(base, _as_spans(runs, "random")))).drop(base)


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each run of overlapping spans."""

    def add(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MARK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)


def secret_model(docs: DataFrame, sample_rows: int = 2000, random_rows: int = 20_000) -> Model:
    """The model for docs (doc_id, text): trained on about sample_rows documents' words and random_rows random strings."""
    return train(labelled_samples(docs, sample_rows, random_rows))
