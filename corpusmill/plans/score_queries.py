"""Queries for losses, benchmark scores, vectors, schedules and trials, each with DuckDB SQL. Floats are rounded to nine places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chat, metrics, rows, skyline
from corpusmill.plans.text_queries import documents, read


def rounded(c: Column) -> Column:
    return F.round(c, 9)


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents as scored tokens: label is the word's length, nll follows from place and length."""
    words = documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    n = F.length("word")
    return words.select("doc_id", "source", F.when(n % 7 == 0, -100).otherwise(n).cast("long").alias("label"), ((F.col("pos") % 13 + 1) * (n + 1) / 16).cast("double").alias("nll"), F.when(F.col("pos") % 5 == 0, 0.5).otherwise(1.0).alias("loss_mask"))


_SCORES = """
words AS (SELECT doc_id, source, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
scores AS (SELECT doc_id, source, CASE WHEN length(word) % 7 = 0 THEN -100 ELSE length(word) END AS label, ((pos % 13 + 1) * (length(word) + 1))::DOUBLE / 16 AS nll, CASE WHEN pos % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS loss_mask FROM words)"""
_KEEP = "CASE WHEN label <> -100 THEN loss_mask ELSE 0 END"


def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.masked_loss(token_scores(spark, sf_dir), ("source",)).select("source", rounded("loss").alias("loss"), "active")


MASKED_LOSS = f"WITH {_SCORES} SELECT source, round(sum(nll * {_KEEP}) / greatest(sum({_KEEP}), 1), 9) AS loss, sum({_KEEP}) AS active FROM scores GROUP BY source"


def masked_loss_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = metrics.masked_loss(token_scores(spark, sf_dir), ("doc_id",)).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.weighted_mean(batches, "loss", "active", ("quality",)).select(F.col("quality").cast("long").alias("quality"), rounded("mean").alias("mean"), "weight")


WEIGHTED_MEAN = f"WITH {_SCORES}, b AS (SELECT doc_id, sum(nll * {_KEEP}) / greatest(sum({_KEEP}), 1) AS loss, sum({_KEEP}) AS active FROM scores GROUP BY doc_id) SELECT quality::BIGINT AS quality, round(sum(loss * active) / sum(active), 9) AS mean, sum(active) AS weight FROM b JOIN labels USING (doc_id) GROUP BY quality"


def bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.range(1, 200).select(F.col("id").alias("token_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("n_bytes"))
    out = metrics.bits_per_byte(token_scores(spark, sf_dir), sizes, ("source",))
    return out.select("source", rounded("nats").alias("nats"), "n_bytes", rounded("bpb").alias("bpb"))


BPB = f"""
WITH {_SCORES}, sized AS (SELECT *, CASE WHEN label BETWEEN 1 AND 199 AND label % 3 <> 0 THEN label ELSE 0 END * loss_mask AS size FROM scores)
SELECT source, round(sum(CASE WHEN size > 0 THEN nll * loss_mask ELSE 0 END), 9) AS nats, sum(size) AS n_bytes, round(sum(CASE WHEN size > 0 THEN nll * loss_mask ELSE 0 END) / (ln(2) * sum(size)), 9) AS bpb FROM sized GROUP BY source"""


def centered_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", F.col("source").alias("task")), "doc_id").select("task", (F.col("quality") == 1).alias("correct"))
    base = spark.range(10).select(F.concat(F.lit("src"), "id").alias("task"), (F.col("id") * 12.5).alias("baseline"))
    out = metrics.centered_scores(items, base)
    return out.select("task", rounded("accuracy").alias("accuracy"), rounded("centered").alias("centered"))


CENTERED = """
WITH a AS (SELECT source AS task, avg((quality = 1)::INT) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1),
b AS (SELECT 'src' || i AS task, i * 12.5::DOUBLE * 0.01 AS base FROM range(10) r(i))
SELECT task, round(accuracy, 9) AS accuracy, round(CASE WHEN coalesce(base, 0) >= 1 THEN accuracy ELSE (accuracy - coalesce(base, 0)) / (1 - coalesce(base, 0)) END, 9) AS centered FROM a LEFT JOIN b USING (task)"""


def mc_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of eight parts of each vector has the least mean; ties go to the first."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    options = v.groupBy("vec_id", F.floor(F.col("i") / 8).alias("option")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("loss"))
    return metrics.best_option(options, ("vec_id",))


MC_ARGMIN = """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
o AS (SELECT vec_id, i // 8 AS option, round(avg(x), 6) AS loss FROM v GROUP BY ALL)
SELECT vec_id, option AS prediction FROM o QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY loss, option) = 1"""


def common_prefix_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(other, "item_id").select("item_id", metrics.common_prefix(F.col("a"), F.concat(F.slice("a", 1, 3), F.col("b"))).alias("prefix"), metrics.common_suffix(F.col("a"), F.concat(F.col("b"), F.slice("a", -2, 2))).alias("suffix"))


COMMON_PREFIX = """
WITH i AS (SELECT x.item_id, string_split(x.text, ' ') AS a, string_split(y.text, ' ') AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1),
p AS (SELECT item_id, a, list_concat(a[1:3], b) AS c, list_reverse(a) AS ra, list_reverse(list_concat(b, a[-2:])) AS rc FROM i)
SELECT item_id, coalesce(list_min(list_filter(range(1, least(len(a), len(c)) + 1), lambda k: a[k] <> c[k])) - 1, least(len(a), len(c))) AS prefix,
  coalesce(list_min(list_filter(range(1, least(len(ra), len(rc)) + 1), lambda k: ra[k] <> rc[k])) - 1, least(len(ra), len(rc))) AS suffix FROM p"""


def stp_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss over three neighbouring vectors."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = lambda k, name: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    return at(0, "s").join(at(1, "r"), "vec_id").join(at(2, "t"), "vec_id").select("vec_id", F.round(metrics.tube_loss(F.col("s"), F.col("r"), F.col("t")), 7).alias("loss"))


STP = """
WITH d AS (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: c.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS f, list_transform(range(1, len(a.embedding) + 1), lambda i: b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE) AS p
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)
SELECT vec_id, round(1 - list_dot_product(f, p) / greatest(sqrt(list_dot_product(f, f)) * sqrt(list_dot_product(p, p)), 1e-8), 7) AS loss FROM d"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials: user modulo 40 is the trial, the event type its seed."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("trial"), F.col("event_type").alias("seed"), "event_id", F.abs("value").alias("v"))
    return e.groupBy("trial", "seed").agg(F.round(F.avg("v"), 6).alias("loss"), F.max("event_id").cast("double").alias("speed"), F.round(F.min("v"), 6).alias("stability")).withColumn("failure", F.when((F.col("trial") == 7) & (F.col("loss") > 0), F.lit("failed")))


_SEEDS = "seeds AS (SELECT user_id % 40 AS trial, event_type AS seed, round(avg(abs(value)), 6) AS loss, max(event_id)::DOUBLE AS speed, round(min(abs(value)), 6) AS stability FROM events GROUP BY ALL)"
_TRIALS = f"""{_SEEDS}, sums AS (SELECT trial, avg(loss) AS loss_mean, stddev_pop(loss) AS loss_std, avg(speed) AS speed_mean, avg(stability) + stddev_pop(loss) AS stability_mean, count(*) FILTER (trial = 7 AND loss > 0) AS failures FROM seeds GROUP BY trial),
trials AS (SELECT *, CASE WHEN failures > 0 THEN 1e9 ELSE loss_mean - 0.03 * ln(greatest(speed_mean, 1)) + 0.20 * stability_mean END AS score FROM sums)"""


def trial_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.aggregate_trials(seeds(spark, sf_dir))
    return t.select("trial", *(F.round(c, 6).alias(c) for c in ("loss_mean", "loss_std", "speed_mean", "stability_mean", "score")), "failures")


TRIALS = f"WITH {_TRIALS} SELECT trial, round(loss_mean, 6) AS loss_mean, round(loss_std, 6) AS loss_std, round(speed_mean, 6) AS speed_mean, round(stability_mean, 6) AS stability_mean, round(score, 6) AS score, failures FROM trials"


def objective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds(spark, sf_dir).select("trial", "seed", F.round(metrics.objective(F.col("loss"), F.col("speed"), F.col("stability")), 6).alias("score"))


OBJECTIVE = f"WITH {_SEEDS} SELECT trial, seed, round(loss - 0.03 * ln(greatest(speed, 1)) + 0.20 * stability, 6) AS score FROM seeds"


def stability_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("v", F.abs("value"))
    runs = e.groupBy((F.col("user_id") % 40).alias("trial")).agg(F.array_sort(F.collect_list(F.when(F.col("event_id") % 3 == 0, F.struct("event_id", "v")))).alias("e"), F.collect_list(F.when(F.col("event_id") % 3 == 1, F.col("v"))).alias("t"), F.collect_list(F.when(F.col("event_id") % 3 == 2, F.col("v") / 40)).alias("g"), F.count_if(F.col("v") > 90).alias("clipped"), F.count("*").alias("steps"), F.max("v").alias("peak"))
    return runs.select("trial", F.round(metrics.stability_penalty(F.col("e.v"), F.col("t"), F.col("g"), F.col("clipped"), F.col("steps"), F.col("peak"), 1.0, 50.0), 6).alias("penalty"))


STABILITY = """
WITH e AS (SELECT user_id % 40 AS trial, event_id, abs(value) AS v, event_id % 3 AS kind FROM events),
r AS (SELECT trial, min(v) FILTER (kind = 0) AS best, arg_max(v, event_id) FILTER (kind = 0) AS last, stddev_pop(v) FILTER (kind = 0) AS es, avg(v) FILTER (kind = 0) AS em, count(*) FILTER (kind = 0) AS en,
  stddev_pop(v) FILTER (kind = 1) AS ts, avg(v) FILTER (kind = 1) AS tm, count(*) FILTER (kind = 1) AS tn, avg(v / 40) FILTER (kind = 2) AS gm, max(v / 40) FILTER (kind = 2) AS gx, count(*) FILTER (v > 90) AS clipped, count(*) AS steps, max(v) AS peak FROM e GROUP BY trial)
SELECT trial, round(clipped / steps + coalesce(0.10 * greatest(gm - 1, 0) + 0.05 * ln(greatest(gx, 1)), 0)
  + CASE WHEN en >= 2 THEN greatest(last - best, 0) / greatest(best, 1) + es / greatest(em, 1) ELSE 0 END + CASE WHEN tn >= 2 THEN 0.05 * ts / greatest(tm, 1) ELSE 0 END + greatest(peak - 50, 0) / 50, 6) AS penalty FROM r"""


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = metrics.aggregate_trials(seeds(spark, sf_dir)).where("failures = 0")
    return skyline.pareto_front(good).select("trial")


PARETO = f"""
WITH {_TRIALS}, good AS (SELECT * FROM trials WHERE failures = 0)
SELECT trial FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.loss_mean <= a.loss_mean AND b.stability_mean <= a.stability_mean AND b.speed_mean >= a.speed_mean
  AND (b.loss_mean < a.loss_mean OR b.stability_mean < a.stability_mean OR b.speed_mean > a.speed_mean))"""


def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.aggregate_trials(seeds(spark, sf_dir))
    best = t.agg(F.min(F.struct("score", "trial")).alias("b"))
    flags = F.concat_ws(" ", F.lit("--trial"), F.col("b.trial"), F.lit("--score"), F.format_string("%.4f", F.col("b.score")))
    return best.select(F.col("b.trial").alias("trial"), F.round("b.score", 6).alias("score"), flags.alias("command"))


BEST_TRIAL = f"WITH {_TRIALS} SELECT trial, round(score, 6) AS score, '--trial ' || trial || ' --score ' || printf('%.4f', score) AS command FROM trials ORDER BY trials.score, trial LIMIT 1"


def throughput_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    span = F.unix_micros("last") - F.unix_micros("first")
    return hours.select(F.unix_seconds("hour").alias("hour"), "n", F.round(F.col("n") / F.greatest(span / 1e6, F.lit(1.0)), 6).alias("per_second"))


THROUGHPUT = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1), 6) AS per_second FROM events GROUP BY date_trunc('hour', ts)"


def loss_curve_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.min_by("value", "event_id") - F.max_by("value", "event_id"), 6).alias("delta"), F.max_by("value", "event_id").alias("last"), F.min("value").alias("best"))


LOSS_CURVE = "SELECT event_type, round(arg_min(value, event_id) - arg_max(value, event_id), 6) AS delta, arg_max(value, event_id) AS last, min(value) AS best FROM events GROUP BY event_type"


def lr_schedule_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate and momentum at each event, as steps of a run."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return e.select("step", rounded(metrics.cosine_schedule(F.col("step"), 200, 1600)).alias("lr"), rounded(metrics.momentum_warmup(F.col("step"), 500, 0.85, 0.95)).alias("momentum"))


COSINE = """
SELECT event_id AS step, round(CASE WHEN event_id < 200 THEN (event_id + 1) / 200 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((event_id - 200) / 1400, 0), 1))) END, 9) AS lr,
  round(CASE WHEN event_id >= 500 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE + 0.1::DOUBLE * event_id / 500 END, 9) AS momentum
FROM events"""


def lr_schedule_wsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return e.select("step", rounded(metrics.stable_decay_schedule(F.col("step"), 200, 1600, 600, 0.2)).alias("lr"))


WSD = """
SELECT event_id AS step, round(CASE WHEN event_id < 200 THEN (event_id + 1) / 200 WHEN event_id < 800 THEN 1 ELSE 0.2::DOUBLE + 0.8::DOUBLE * (1 - least(greatest((event_id - 800) / 800, 0), 1)) END, 9) AS lr
FROM events"""


def topk_topp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: F.round(x.cast("double") * 20, 4))
    v = read(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"))
    size = lambda c: F.size(F.filter(c, lambda x: x.isNotNull())).cast("long")
    return v.select("vec_id", size(metrics.filtered_logits(F.col("logits"), top_k=5)).alias("top_k"), size(metrics.filtered_logits(F.col("logits"), top_p=0.9)).alias("top_p"))


TOP_KP = """
WITH v AS (SELECT vec_id, round(unnest(embedding)::DOUBLE * 20, 4) AS x FROM embeddings),
r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS k, sum(exp(x)) OVER (PARTITION BY vec_id ORDER BY x DESC ROWS UNBOUNDED PRECEDING) / sum(exp(x)) OVER (PARTITION BY vec_id) AS c FROM v),
e AS (SELECT *, min(CASE WHEN k = 1 OR c <= 0.9 THEN x END) OVER (PARTITION BY vec_id) AS edge FROM r)
SELECT vec_id, count(*) FILTER (k <= 5) AS top_k, count(*) FILTER (x >= edge) AS top_p FROM e GROUP BY vec_id"""


def z_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.when(F.col("vec_id") % 4 == 0, -100).otherwise(F.col("label")).alias("label"), F.lit(1.0).alias("loss_mask"))
    return metrics.z_loss(v).select(F.round("z_loss", 6).alias("z_loss"))


Z_LOSS = "WITH v AS (SELECT vec_id, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS z FROM embeddings WHERE vec_id % 4 <> 0) SELECT round(sum(z * z) / greatest(count(*), 1), 6) AS z_loss FROM v"


def few_shot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots drawn for each item: how many, how many of them different, and whether the item is among them."""
    shots = rows.few_shot(read(spark, sf_dir, "benchmark"), 5)
    return shots.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("shot").alias("different"), F.count_if(F.col("shot") == F.col("item_id")).alias("own"))


FEW_SHOT = "SELECT item_id, least(5, (SELECT count(*) FROM benchmark) - 1) AS n, least(5, (SELECT count(*) FROM benchmark) - 1) AS different, 0::BIGINT AS own FROM benchmark"


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", chat.is_host(F.col("url"), "blog.tionsh.example.net").alias("hit"))


URL_HOSTS = "SELECT page_id, coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) = 'blog.tionsh.example.net', FALSE) AS hit FROM pages"

QUERIES = {
    "masked_loss": masked_loss, "masked_loss_weighted_mean": masked_loss_weighted_mean, "bpb": bpb, "centered_accuracy": centered_accuracy, "mc_argmin": mc_argmin, "common_prefix_len": common_prefix_len,
    "stp_cosine": stp_cosine, "trial_aggregate": trial_aggregate, "objective_score": objective_score, "stability_penalty": stability_penalty, "pareto_front": pareto_front, "best_trial": best_trial,
    "throughput_by_window": throughput_by_window, "loss_curve_delta": loss_curve_delta, "lr_schedule_cosine": lr_schedule_cosine, "lr_schedule_wsd": lr_schedule_wsd, "topk_topp_filter": topk_topp_filter,
    "z_loss": z_loss, "few_shot_counts": few_shot_counts, "url_hosts": url_hosts,
}
ORACLES = {
    "masked_loss": MASKED_LOSS, "masked_loss_weighted_mean": WEIGHTED_MEAN, "bpb": BPB, "centered_accuracy": CENTERED, "mc_argmin": MC_ARGMIN, "common_prefix_len": COMMON_PREFIX,
    "stp_cosine": STP, "trial_aggregate": TRIALS, "objective_score": OBJECTIVE, "stability_penalty": STABILITY, "pareto_front": PARETO, "best_trial": BEST_TRIAL,
    "throughput_by_window": THROUGHPUT, "loss_curve_delta": LOSS_CURVE, "lr_schedule_cosine": COSINE, "lr_schedule_wsd": WSD, "topk_topp_filter": TOP_KP,
    "z_loss": Z_LOSS, "few_shot_counts": FEW_SHOT, "url_hosts": URL_HOSTS,
}
