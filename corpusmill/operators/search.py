"""Trials of a parameter search: drawing parameters, parsing candidates, failed seeds, summaries and commands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators.metrics import FAILED, is_finite

# Words for yes and no, the loss from which a trial counts as failed, and the weight of speed in a probe's score.
YES, NO = ("1", "true", "yes", "on", "gc"), ("0", "false", "no", "off", "nogc")
TOO_HIGH, PROBE_SPEED = 1e8, 0.01
_PLAIN = r"^[A-Za-z0-9@%+=:,./_-]+$"


def unit_draw(*key) -> Column:
    """A number in [0, 1) that follows from the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def categorical(draw: Column, choices: list) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(draw * len(choices)) + 1).cast("int"))


def uniform(draw: Column, low: float, high: float, log: bool = False) -> Column:
    """low to high, evenly or, with ``log``, evenly in the logarithm."""
    if log:
        return F.exp(math.log(low) + draw * (math.log(high) - math.log(low)))
    return low + draw * (high - low)


def parse_candidate(text: Column) -> Column:
    """batch:accumulation:flag as (batch, accumulation, checkpointing, effective, label); anything else fails the query."""
    parts = F.transform(F.split(text, ":"), lambda x: F.lower(strip(x)))
    batch, times, flag = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int"), F.try_element_at(parts, F.lit(3))
    fault = F.when(F.size(parts) != 3, "a candidate is batch:accumulation:flag").when(~flag.isin(*YES, *NO), "the flag is neither yes nor no").when(F.coalesce((batch <= 0) | (times <= 0), F.lit(True)), "batch and accumulation are positive numbers")
    label = F.concat(F.lit("b"), batch, F.lit("-a"), times, F.when(flag.isin(*YES), "-gc").otherwise("-nogc"))
    found = F.struct(batch.alias("batch"), times.alias("accumulation"), flag.isin(*YES).alias("checkpointing"), (batch * times).alias("effective"), label.alias("label"))
    return F.when(fault.isNull(), found).otherwise(F.raise_error(fault))


def parse_candidates(text: Column) -> Column:
    """A comma-separated list of candidates; an empty one fails the query."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, F.transform(items, parse_candidate)).otherwise(F.raise_error(F.lit("the list is empty")))


def successful(trials: DataFrame) -> DataFrame:
    """Trials (failures, loss_mean) without a failed seed and with a loss below the limit."""
    return trials.where((F.col("failures") == 0) & (F.col("loss_mean") < TOO_HIGH))


def until_first_failure(seeds: DataFrame, by: str = "trial", order: str = "seed") -> DataFrame:
    """The seeds of each trial up to the first that failed (failure isn't null), that one included: a failed seed stops its trial."""
    first = seeds.where("failure is not null").groupBy(by).agg(F.min(order).alias("_stop"))
    return seeds.join(first, by, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def failed_seed(seed: Column, reason: Column) -> Column:
    """The record of a seed that failed: losses, score and penalty of 1e9, no speed, other measurements null."""
    bad = lambda name: F.lit(FAILED).alias(name)
    none = lambda name: F.lit(None).cast("double").alias(name)
    zeros = [F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("speed")]
    return F.struct(seed.alias("seed"), *zeros, none("first_loss"), bad("best_loss"), bad("last_loss"), none("best_bpb"), none("last_bpb"), none("best_core"), none("last_core"), bad("score"), bad("stability"), none("clip_ratio"), none("mean_norm"), none("most_norm"), none("loss_mean"), none("loss_std"), reason.alias("failure"), F.coalesce(F.lower(reason).contains("out of memory"), F.lit(False)).alias("out_of_memory"))


def seed_summary(measurements: DataFrame, by: tuple[str, ...], value: str, order: str) -> DataFrame:
    """first, last, least, most, mean and deviation of a run's finite values in order, and the last over the least."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    rows = measurements.withColumn("_v", v).where("_v is not null")
    out = rows.groupBy(*by).agg(F.min_by("_v", order).alias("first"), F.max_by("_v", order).alias("last"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("deviation"))
    return out.withColumn("ratio", F.when(F.col("least") != 0, F.col("last") / F.col("least")))


def probe_summary(runs: DataFrame) -> DataFrame:
    """The best run (label, ok, loss, speed) by loss and by loss less 0.01 ln(speed); failed runs don't count, of equal ones the first label is best."""
    score = F.col("loss") - PROBE_SPEED * F.log(F.greatest(F.col("speed"), F.lit(1.0)))
    return runs.where("ok").agg(F.min(F.struct("loss", "label"))["label"].alias("best_by_loss"), F.min(F.struct(score.alias("s"), "label"))["label"].alias("best_by_score"), F.count("*").alias("runs"))


def quoted(word: Column) -> Column:
    """A word as a shell takes it."""
    return F.when(word.rlike(_PLAIN), word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def number_text(value: Column) -> Column:
    """Up to eight significant digits, without zeros at the end."""
    digits = F.greatest(F.lit(0), 7 - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300))))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", F.round(value, 12)), r"0+$", ""), r"\.$", "")
    small = F.when(F.abs(value) >= 1e-4, F.regexp_replace(F.regexp_replace(F.format_string("%.8f", value), r"0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(value == 0, "0").when(digits <= 8, small).otherwise(plain)


def command(program: list[str], flags: list[tuple[str, Column]]) -> Column:
    """A command line: the program's words, then each flag whose value isn't null, in order; true alone stands for a flag without a value."""
    parts = [F.lit(" ".join(program))]
    for name, value in flags:
        parts.append(F.when(value == "true", F.lit(name)).when(value.isNotNull(), F.concat(F.lit(name + " "), quoted(value))))
    return F.concat_ws(" ", *parts)
