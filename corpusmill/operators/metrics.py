"""Losses, bits per byte, benchmark scores, schedules and trial ranking over tables of measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from corpusmill.functions.text import let

# Weights and limits of the trial objective.
SPEED_WEIGHT, STABILITY_WEIGHT, LEAST_LOSS, FAILED = 0.03, 0.20, -1e-3, 1e9


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def json_safe(c: Column, kind: DataType) -> Column:
    """A value of this type with null for every number in it that isn't finite, in arrays, maps and structs too."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: json_safe(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(json_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def finite(c: Column) -> Column:
    """The value, null where it isn't finite."""
    return F.when(is_finite(c), c)


def masked_loss(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """loss and active tokens of scores (label, nll, loss_mask): the mask's mean, labels of -100 left out."""
    keep = F.when(F.col("label") != -100, F.col("loss_mask")).otherwise(0.0)
    return scores.groupBy(*by).agg((F.sum(F.col("nll") * keep) / F.greatest(F.sum(keep), F.lit(1.0))).alias("loss"), F.sum(keep).alias("active"))


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def z_loss(scores: DataFrame) -> DataFrame:
    keep = F.when(F.col("label") != -100, F.col("loss_mask")).otherwise(0.0)
    return scores.agg((F.sum(F.pow(log_sum_exp(F.col("logits")), 2) * keep) / F.greatest(F.sum(keep), F.lit(1.0))).alias("z_loss"))


def bits_per_byte(scores: DataFrame, token_bytes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """nats, n_bytes and bpb of scores (label, nll, loss_mask) with token_bytes (token_id, n_bytes), which has one row for each token of a vocabulary."""
    joined = scores.join(token_bytes, scores["label"] == token_bytes["token_id"], "left")
    size = F.when(F.col("label") != -100, F.coalesce("n_bytes", F.lit(0)) * F.col("loss_mask")).otherwise(0.0)
    out = joined.groupBy(*by).agg(F.sum(F.when(size > 0, F.col("nll") * F.col("loss_mask")).otherwise(0.0)).alias("nats"), F.sum(size).alias("n_bytes"))
    return out.withColumn("bpb", F.when(F.col("n_bytes") > 0, F.col("nats") / (math.log(2) * F.col("n_bytes"))).otherwise(float("nan")))


def weighted_mean(batches: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.sum(weight)
    return batches.groupBy(*by).agg(F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(float("nan")).alias("mean"), total.alias("weight"))


def centered_scores(items: DataFrame, baselines: DataFrame) -> DataFrame:
    """task, accuracy and centered accuracy of items (task, correct) against baselines (task, baseline percent); tasks without one count 0."""
    accuracy = items.groupBy("task").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    base = F.coalesce(F.col("baseline"), F.lit(0.0)) * 0.01
    return accuracy.join(baselines, "task", "left").select("task", "accuracy", F.when(base >= 1, F.col("accuracy")).otherwise((F.col("accuracy") - base) / (1 - base)).alias("centered"))


def best_option(options: DataFrame, by: tuple[str, ...], loss: str = "loss", index: str = "option") -> DataFrame:
    """The option of least loss for each item; options without a loss come last, of equal ones the first."""
    return options.groupBy(*by).agg(F.min(F.struct(F.coalesce(loss, F.lit(float("inf"))).alias("l"), F.col(index).alias("i")))["i"].alias("prediction"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    apart = F.array_position(F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


def tube_loss(s: Column, r: Column, t: Column) -> Column:
    """1 - cos(t - r, r - s) of three vectors of one span, in order."""
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") - q)
    return 1 - cosine(minus(t, r), minus(r, s))


def tube_triples(spans: DataFrame, key: tuple[str, ...], samples: int = 1, max_width: int | None = None, seed: int = 0) -> DataFrame:
    """key, begin, end, draw, s, r and t: ``samples`` draws of three places s < r < t inside each span [begin, end), at most ``max_width`` from s to t.

    Draws come from a hash of seed, key, begin and draw. Spans of fewer than three places give
    none, and neither does a draw that max_width leaves no room for.
    """
    if samples < 1 or max_width is not None and max_width < 2:
        raise ValueError("samples must be 1 at least, and max_width 2")
    rows = spans.where("end - begin >= 3").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in key), F.col("begin").cast("string"), F.col("draw").cast("string")))
    number = lambda k: F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long")
    drawn = lambda low, high, k: (low + F.pmod(number(k), F.greatest(high - low, F.lit(1)))).cast("long")
    last = F.col("end") - 2 if max_width is None else F.greatest(F.col("begin") + 1, F.col("end") - 2)
    rows = rows.withColumn("_digest", digest).withColumn("s", drawn(F.col("begin"), last, 0))
    rows = rows.withColumn("_stop", F.col("end") if max_width is None else F.least(F.col("end"), F.col("s") + max_width + 1)).where("_stop - s >= 3")
    rows = rows.withColumn("r", drawn(F.col("s") + 1, F.col("_stop") - 1, 1))
    return rows.withColumn("t", drawn(F.col("r") + 1, F.col("_stop"), 2)).select(*key, "begin", "end", "draw", "s", "r", "t")


def tube_losses(hidden: DataFrame, triples: DataFrame, key: tuple[str, ...], place: str = "place", vector: str = "vector") -> DataFrame:
    """triples with loss, from the vectors of hidden (key, place, vector) at s, r and t. The vectors meet by key and place; a triple without one of them is dropped."""
    rows = triples.withColumn("_id", F.struct(*key, "begin", "draw")).select("*", F.posexplode(F.array("s", "r", "t")).alias("_which", "_at"))
    own = hidden.select(*key, F.col(place).alias("_at"), F.col(vector).alias("_vector"))
    gathered = rows.join(own, [*key, "_at"]).groupBy(*triples.columns).agg(F.map_from_entries(F.collect_list(F.struct("_which", "_vector"))).alias("_v"))
    loss = tube_loss(*(F.col("_v")[k] for k in range(3)))
    return gathered.where(F.size("_v") == 3).withColumn("loss", loss).drop("_v")


def mean_tube_loss(losses: DataFrame) -> DataFrame:
    """(loss, n): the mean over all draws, 0 if there are none."""
    return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))


def rms_norm(x: Column, weight: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x)
    return F.zip_with(x, weight, lambda v, w: v * w / F.sqrt(mean + eps))


def objective(loss: Column, speed: Column, stability: Column) -> Column:
    """A trial's score: loss, less for speed, more for instability; 1e9 for a loss that can't be."""
    return F.when(~is_finite(loss) | (loss < LEAST_LOSS), FAILED).otherwise(loss - SPEED_WEIGHT * F.log(F.greatest(speed, F.lit(1.0))) + STABILITY_WEIGHT * stability)


def stability_penalty(evals: Column, trains: Column, norms: Column, clipped: Column, steps: Column, peak: Column, clip: float = 1.0, peak_limit: float = 0.0) -> Column:
    """How unstable a run was, from arrays of evaluation losses (in order), training losses and gradient norms."""
    only = lambda xs: F.filter(xs, is_finite)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    spread = lambda xs: let(mean(xs), lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, v: s + F.pow(v - m, 2)) / F.size(xs)) / F.greatest(m, F.lit(1.0)))
    e, t, g = only(evals), only(trains), only(norms)
    grad = F.when((F.size(g) > 0) & F.lit(clip > 0), 0.10 * F.greatest(mean(g) / clip - 1, F.lit(0.0)) + 0.05 * F.log(F.greatest(F.array_max(g) / clip, F.lit(1.0)))).otherwise(0.0)
    rise = F.when(F.size(e) >= 2, F.greatest(F.element_at(e, -1) - F.array_min(e), F.lit(0.0)) / F.greatest(F.array_min(e), F.lit(1.0)) + spread(e)).otherwise(0.0)
    rough = F.when(F.size(t) >= 2, 0.05 * spread(t)).otherwise(0.0)
    high = F.greatest(F.coalesce(peak, F.lit(0.0)) - peak_limit, F.lit(0.0)) / peak_limit if peak_limit > 0 else F.lit(0.0)
    return F.when(steps <= 0, 1000.0).otherwise(clipped / F.greatest(steps, F.lit(1)) + grad + rise + rough + high)


def aggregate_trials(seeds: DataFrame, std_weight: float = 1.0) -> DataFrame:
    """One row for each trial of seeds (trial, loss, speed, stability, failure): means, the losses' deviation and the score."""
    out = seeds.groupBy("trial").agg(F.avg("loss").alias("loss_mean"), F.stddev_pop("loss").alias("loss_std"), F.avg("speed").alias("speed_mean"), F.avg("stability").alias("stability_own"), F.count("failure").alias("failures"))
    stability = F.col("stability_own") + std_weight * F.coalesce("loss_std", F.lit(0.0))
    return out.select("trial", "loss_mean", F.coalesce("loss_std", F.lit(0.0)).alias("loss_std"), "speed_mean", stability.alias("stability_mean"), "failures").withColumn("score", F.when(F.col("failures") > 0, FAILED).otherwise(objective(F.col("loss_mean"), F.col("speed_mean"), F.col("stability_mean"))))


def failed_trial(reason: Column) -> Column:
    """The values of a trial that failed; messages about memory are told apart."""
    return F.struct(F.lit(FAILED).alias("loss"), F.lit(0.0).alias("speed"), F.lit(FAILED).alias("stability"), reason.alias("failure"), F.lower(reason).contains("out of memory").alias("out_of_memory"))


def exact_match(predicted: Column, ids: Column, begin: Column, end: Column) -> Column:
    """Whether a language model's predictions for places begin to end (each made one place before) are the ids there; an empty range, or one from 0, is wrong."""
    part = lambda x, a, b: F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))
    return F.when((begin <= 0) | (end <= begin), False).otherwise(part(predicted, begin - 1, end - 1) == part(ids, begin, end))


def continuation_start(without: Column, whole: Column) -> Column:
    """Where a prompt's continuation starts in the whole's ids: after the prompt's ids, or, where the two differ before, at the first difference."""
    n = F.size(without)
    return F.when(F.slice(whole, F.lit(1), n) == without, n.cast("long")).otherwise(common_prefix(without, whole))


def cosine_schedule(step: Column, warmup: int, most: int, least: float = 0.1) -> Column:
    part = F.least(F.greatest((step - warmup) / max(1, most - warmup), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * part)))


def stable_decay_schedule(step: Column, warmup: int, most: int, stable: int = 0, least: float = 0.0) -> Column:
    start = warmup + max(0, stable)
    part = F.least(F.greatest((step - start) / max(1, most - start), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / max(1, warmup)).when(step < start, 1.0).otherwise(least + (1 - least) * (1 - part))


def momentum_warmup(step: Column, warmup: int, start: float, end: float) -> Column:
    return F.lit(end) if warmup <= 0 else F.when(step >= warmup, end).otherwise(start + (end - start) * step / warmup)


def filtered_logits(logits: Column, top_k: int = 0, top_p: float = 1.0) -> Column:
    """Logits outside the top k, or outside the nucleus of probability top_p, become null; the largest always stays."""
    cut = F.element_at(F.sort_array(logits, False), F.least(F.lit(top_k), F.size(logits))) if top_k > 0 else F.lit(None)
    kept = let(cut, lambda c: F.transform(logits, lambda x: F.when(x >= c, x))) if top_k > 0 else logits
    if not 0 < top_p < 1:
        return kept
    ranked = F.sort_array(F.filter(kept, lambda x: x.isNotNull()), False)

    def least(x: Column) -> Column:
        """The smallest logit inside the nucleus."""
        start = F.struct(F.lit(0.0).alias("sum"), F.element_at(x["ranked"], 1).cast("double").alias("least"))

        def add(acc: Column, y: Column) -> Column:
            total = acc["sum"] + F.exp(y - x["total"])
            return F.struct(total.alias("sum"), F.when(total <= top_p, y.cast("double")).otherwise(acc["least"]).alias("least"))

        return F.aggregate(x["ranked"], start, add, lambda acc: acc["least"])

    edge = let(let(ranked, lambda r: F.struct(r.alias("ranked"), log_sum_exp(r).alias("total"))), least)
    return let(edge, lambda e: F.transform(kept, lambda x: F.when(x >= e, x)))


def left_truncated(ids: Column, begin: Column, end: Column, most: int) -> Column:
    """The last ``most`` ids, and the scored range moved with them."""
    drop = F.greatest(F.size(ids) - most, F.lit(0))
    return F.struct(F.slice(ids, drop + 1, F.lit(most)).alias("ids"), F.greatest(begin - drop, F.lit(0)).alias("begin"), (end - drop).alias("end"))


def step_cap(steps: int, stages: int) -> int:
    """Steps of each stage when ``steps`` are shared out, rounded up."""
    return -(-steps // stages)
