"""Queries over measurements: parameter draws, candidates, failed seeds, summaries, checks and small kernels, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import checks, metrics, numerics, search
from corpusmill.plans.text_queries import read


def _total(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("p_partkey") % 2 == 0, F.lit(" GC")).otherwise("off")
    text = F.concat_ws(",", F.concat_ws(":", F.col("p_size").cast("string"), (F.col("p_partkey") % 7 + 1).cast("string"), flag), F.lit(""))
    c = F.get(search.parse_candidates(text), F.lit(0))
    return read(spark, sf_dir, "part").select("p_partkey", c["effective"].cast("long").alias("effective"), c["checkpointing"].alias("checkpointing"), c["label"].alias("label"))


CANDIDATES = "SELECT p_partkey, (p_size * (p_partkey % 7 + 1))::BIGINT AS effective, p_partkey % 2 = 0 AS checkpointing, 'b' || p_size || '-a' || (p_partkey % 7 + 1) || CASE WHEN p_partkey % 2 = 0 THEN '-gc' ELSE '-nogc' END AS label FROM part"


def parameter_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from evenly spaced numbers, so that SQL can follow them."""
    u = (F.col("c_custkey") % 1000) / 1000.0
    return read(spark, sf_dir, "customer").select("c_custkey", search.categorical(u, [8, 16, 32]).cast("long").alias("batch"), F.round(search.uniform(u, 0.1, 0.9), 9).alias("ratio"), F.round(search.uniform(u, 1e-5, 1e-2, log=True), 12).alias("rate"))


DRAWS = "WITH d AS (SELECT c_custkey, (c_custkey % 1000) / 1000.0::DOUBLE AS u FROM customer) SELECT c_custkey, [8, 16, 32][floor(u * 3)::INTEGER + 1]::BIGINT AS batch, round(0.1::DOUBLE + u * 0.8::DOUBLE, 9) AS ratio, round(exp(ln(1e-5::DOUBLE) + u * (ln(1e-2::DOUBLE) - ln(1e-5::DOUBLE))), 12) AS rate FROM d"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("trial"), (F.col("event_id") % 4).alias("seed"))
    loss = F.avg(F.abs("value"))
    return e.agg(loss.alias("loss"), F.count("*").alias("speed")).withColumn("failure", F.when((F.col("trial") * 7 + F.col("seed") * 3) % 11 == 0, F.concat(F.lit("CUDA Out Of Memory "), F.col("seed").cast("string"))))


_SEEDS = "s AS (SELECT *, CASE WHEN (trial * 7 + seed * 3) % 11 = 0 THEN 'CUDA Out Of Memory ' || seed END AS failure FROM (SELECT user_id % 50 AS trial, event_id % 4 AS seed, avg(abs(value)) AS loss, count(*) AS speed FROM events GROUP BY ALL))"


def seeds_until_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = search.until_first_failure(_seeds(spark, sf_dir))
    f = search.failed_seed(F.col("seed"), F.col("failure"))
    loss = F.when(F.col("failure").isNotNull(), f["best_loss"]).otherwise(F.col("loss"))
    return kept.select("trial", "seed", F.round(loss, 6).alias("loss"), F.when(F.col("failure").isNotNull(), f["out_of_memory"]).otherwise(False).alias("out_of_memory"), F.when(F.col("failure").isNotNull(), f["loss_mean"].isNull()).otherwise(False).alias("nulls"))


UNTIL_FAILURE = f"WITH {_SEEDS}, f AS (SELECT *, min(seed) FILTER (failure IS NOT NULL) OVER (PARTITION BY trial) AS stop FROM s) SELECT trial, seed, round(CASE WHEN failure IS NULL THEN loss ELSE 1e9 END, 6) AS loss, failure IS NOT NULL AS out_of_memory, failure IS NOT NULL AS nulls FROM f WHERE stop IS NULL OR seed <= stop"


def good_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _seeds(spark, sf_dir).groupBy("trial").agg((F.avg("loss") * F.when(F.col("trial") % 9 == 0, 1e9).otherwise(1.0)).alias("loss_mean"), F.count("failure").alias("failures"))
    return search.successful(t).select("trial")


GOOD_TRIALS = f"WITH {_SEEDS} SELECT trial FROM s GROUP BY trial HAVING count(failure) = 0 AND avg(loss) * CASE WHEN trial % 9 = 0 THEN 1e9 ELSE 1 END < 1e8"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("run"), "event_id", F.when(F.col("event_id") % 6 == 0, float("nan")).otherwise(F.abs("value") + 1).alias("v"))
    s = search.seed_summary(e, ("run",), "v", "event_id")
    return s.select("run", *(F.round(c, 6).alias(c) for c in ("first", "last", "least", "most", "mean", "deviation", "ratio")))


RUN_SUMMARY = """
WITH e AS (SELECT user_id % 40 AS run, event_id, abs(value) + 1 AS v FROM events WHERE event_id % 6 <> 0 AND value IS NOT NULL)
SELECT run, round(arg_min(v, event_id), 6) AS first, round(arg_max(v, event_id), 6) AS last, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(arg_max(v, event_id) / min(v), 6) AS ratio FROM e GROUP BY run"""


def probe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _seeds(spark, sf_dir).select(F.concat_ws("-", F.col("trial").cast("string"), F.col("seed").cast("string")).alias("label"), F.col("failure").isNull().alias("ok"), "loss", F.col("speed").cast("double").alias("speed"))
    return search.probe_summary(runs)


PROBE_BEST = f"WITH {_SEEDS}, r AS (SELECT trial || '-' || seed AS label, loss, loss - 0.01 * ln(greatest(speed, 1)) AS score FROM s WHERE failure IS NULL) SELECT (SELECT label FROM r ORDER BY loss, label LIMIT 1) AS best_by_loss, (SELECT label FROM r ORDER BY score, label LIMIT 1) AS best_by_score, count(*) AS runs FROM r"


def run_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [("--name", F.col("p_name")), ("--size", F.col("p_size").cast("string")), ("--price", search.number_text(F.col("p_partkey") / 8.0)), ("--even", F.when(F.col("p_partkey") % 2 == 0, "true")), ("--quote", F.when(F.col("p_partkey") % 3 == 0, F.lit("it's")))]
    return read(spark, sf_dir, "part").select("p_partkey", search.command(["python", "-m", "train"], flags).alias("command"))


COMMANDS = r"""SELECT p_partkey, 'python -m train --name ' || CASE WHEN regexp_matches(p_name, '^[A-Za-z0-9@%+=:,./_-]+$') THEN p_name ELSE '''' || p_name || '''' END || ' --size ' || p_size
  || ' --price ' || rtrim(rtrim(printf('%.8f', p_partkey / 8.0), '0'), '.') || CASE WHEN p_partkey % 2 = 0 THEN ' --even' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' --quote ''it''"''"''s''' ELSE '' END AS command FROM part"""


def sane_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount")).alias("r"))
    ids, mask = F.transform("r", lambda x: x["l_partkey"]), F.transform("r", lambda x: x["l_discount"] * 10.2)
    labels = F.transform("r", lambda x: F.when(x["l_linenumber"] == 1, -100).otherwise(x["l_partkey"]))
    return li.select("l_orderkey", checks.is_sane(ids, labels, mask, F.transform("r", lambda x: x["l_linenumber"] - 1), 150).alias("sane"))


SANE = "SELECT l_orderkey, bool_and(l_partkey BETWEEN 0 AND 149 AND l_discount * 10.2::DOUBLE BETWEEN 0 AND 1 AND l_linenumber >= 1) AS sane FROM lineitem GROUP BY l_orderkey"


def checked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = F.when(F.col("event_id") % 5 == 0, -0.0005).otherwise(F.abs("value"))
    return read(spark, sf_dir, "events").select("event_id", F.round(checks.checked_loss(loss), 6).alias("loss"))


CHECKED_LOSSES = "SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE abs(value) END, 6) AS loss FROM events"


def language_model_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that predicts code point k from k - 1 of a text, but is wrong at each multiple of 40; texts' starts come from a prompt that differs in some."""
    points = F.transform(F.split("text", ""), F.ascii)
    whole = F.when(F.size(points) > 8, points).otherwise(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i))
    d = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", whole.alias("ids"))
    without = F.concat(F.slice("ids", 1, 5), F.when(F.col("doc_id") % 2 == 0, F.slice("ids", 6, 1)).otherwise(F.array(F.lit(-1))))
    d = d.withColumn("start", metrics.continuation_start(without, F.col("ids"))).withColumn("end", F.col("start") + F.pmod("doc_id", F.lit(60)))
    d = d.withColumn("end", F.least(F.col("end"), F.size("ids").cast("long")))
    predicted = F.transform(F.slice("ids", F.lit(2), F.size("ids")), lambda v, i: F.when((i + 1) % 40 == 0, -5).otherwise(v))
    return d.select("doc_id", "start", metrics.exact_match(predicted, F.col("ids"), F.col("start").cast("int"), F.col("end").cast("int")).alias("hit"))


LM_MATCHES = """
WITH d AS (SELECT doc_id, CASE WHEN length(text) > 8 THEN length(text) ELSE 64 END AS n, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 5 END AS s FROM documents WHERE text <> ''),
e AS (SELECT doc_id, s, least(s + doc_id % 60, n) AS e FROM d)
SELECT doc_id, s::BIGINT AS start, e > s AND NOT (40 >= s AND 40 < e) AS hit FROM e"""


def unit_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    found = metrics.rms_norm(v, F.transform(v, lambda x, i: F.lit(1.0) + i / 64.0))
    return read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.round(_total(found), 6).alias("total"), F.round(found[3], 6).alias("third"))


_EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)"
NORMS = f"WITH {_EMB}, m AS (SELECT vec_id, v, sqrt(list_avg(list_transform(v, lambda x: x * x)) + 1e-6::DOUBLE) AS m FROM e) SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * (1 + (i - 1) / 64.0::DOUBLE))) / m, 6) AS total, round(v[4] * (1 + 3 / 64.0::DOUBLE) / m, 6) AS third FROM m"


def rotary_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all turned components and of their products with their places, and the length, which turning keeps."""
    v = F.col("embedding").cast("array<double>")
    found = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", numerics.rotary(v, (F.col("vec_id") % 50).cast("double"), 64).alias("t"))
    placed = F.transform("t", lambda x, i: x * (i + 1))
    return found.select("vec_id", F.round(_total(F.col("t")), 6).alias("total"), F.round(_total(placed), 5).alias("placed"), F.round(_total(F.transform("t", lambda x: x * x)), 6).alias("squares"))


ROTARY = f"""
WITH {_EMB}, a AS (SELECT vec_id, v, i, (vec_id % 50) / pow(10000::DOUBLE, ((i - 1) % 32) * 2 / 64.0::DOUBLE) AS angle FROM e, unnest(range(1, 65)) AS u(i)),
t AS (SELECT vec_id, i, v[i] * cos(angle) + CASE WHEN i <= 32 THEN -v[i + 32] ELSE v[i - 32] END * sin(angle) AS t FROM a)
SELECT vec_id, round(sum(t), 6) AS total, round(sum(t * i), 5) AS placed, round(sum(t * t), 6) AS squares FROM t GROUP BY vec_id"""


def residual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of three states of all 64 components, by sums that each component enters with its place."""
    v = F.col("embedding").cast("array<double>")
    states = F.array(v, F.reverse(v), F.transform(v, lambda x: x * 2.0 + 0.1))
    query = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(i * 7, F.lit(11)) / 4.0 - 1.0)
    weight = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(0.5) + F.pmod(i, F.lit(3)) / 2.0)
    found = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", numerics.residual_mix(states, query, weight).alias("m"))
    return found.select("vec_id", F.round(_total(F.col("m")), 6).alias("total"), F.round(_total(F.transform("m", lambda x, i: x * (i + 1))), 5).alias("placed"))


RESIDUAL = f"""
WITH {_EMB}, s AS (SELECT vec_id, k, i, CASE k WHEN 1 THEN v[i] WHEN 2 THEN v[65 - i] ELSE v[i] * 2 + 0.1::DOUBLE END AS x FROM e, unnest(range(1, 65)) AS u(i), unnest([1, 2, 3]) AS w(k)),
g AS (SELECT vec_id, k, exp(sum(x * ((i * 7 % 11) / 4.0::DOUBLE - 1) * (0.5::DOUBLE + (i % 3) / 2.0::DOUBLE)) / sqrt(sum(x * x) / 64 + 1e-6::DOUBLE)) AS w FROM s GROUP BY vec_id, k)
SELECT vec_id, round(sum(w * x) / any_value(t), 6) AS total, round(sum(w * x * i) / any_value(t), 5) AS placed
FROM s JOIN g USING (vec_id, k) JOIN (SELECT vec_id, sum(w) AS t FROM g GROUP BY vec_id) USING (vec_id) GROUP BY vec_id"""


def reset_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of width two over each order's lines, cleared at every fifth: it decays, is projected, and gains what a line holds."""
    two = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    li = read(spark, sf_dir, "lineitem").withColumn("t", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1).cast("long"))
    q, s = F.col("l_quantity") / 7, F.col("l_linenumber") / 2.7
    fields = {"r": two(q, F.lit(1)), "k": two(s, F.lit(0.5)), "v": two(q, s), "w": two(F.lit(0.5), F.lit(0.75)), "a": two(F.lit(0.1), s / 8), "b": two(F.lit(0.5), F.lit(-0.25))}
    steps = li.select(F.col("l_orderkey").alias("seq"), "t", (F.col("t") % 5 == 0).alias("reset"), *(x.alias(c) for c, x in fields.items()))
    return numerics.recurrence(steps, 2).select("seq", "t", F.round(F.col("out")[0], 5).alias("first"), F.round(F.col("out")[1], 5).alias("second"))


RECURRENCE = """
WITH RECURSIVE r AS (
  SELECT l_orderkey AS seq, l_quantity::DOUBLE / 7 AS q, l_linenumber / 2.7::DOUBLE AS s,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS t
  FROM lineitem),
st AS (
  SELECT seq, t, q, q * s AS a, q * 0.5::DOUBLE AS b, s * s AS c, s * 0.5::DOUBLE AS d FROM r WHERE t = 0
  UNION ALL
  SELECT r.seq, r.t, r.q,
    k * (a * 0.5::DOUBLE + (a * 0.1::DOUBLE + b * s / 8) * 0.5::DOUBLE) + r.q * s, k * (b * 0.75::DOUBLE - (a * 0.1::DOUBLE + b * s / 8) * 0.25::DOUBLE) + r.q * 0.5::DOUBLE,
    k * (c * 0.5::DOUBLE + (c * 0.1::DOUBLE + d * s / 8) * 0.5::DOUBLE) + s * s, k * (d * 0.75::DOUBLE - (c * 0.1::DOUBLE + d * s / 8) * 0.25::DOUBLE) + s * 0.5::DOUBLE
  FROM st JOIN r ON r.seq = st.seq AND r.t = st.t + 1, LATERAL (SELECT CASE WHEN r.t % 5 = 0 THEN 0 ELSE 1 END::DOUBLE AS k))
SELECT seq, t::BIGINT AS t, round(a * q + b, 5) AS first, round(c * q + d, 5) AS second FROM st"""

QUERIES = {
    "candidates": candidates, "parameter_draws": parameter_draws, "seeds_until_failure": seeds_until_failure, "good_trials": good_trials, "run_summary": run_summary, "probe_best": probe_best,
    "run_commands": run_commands, "sane_batches": sane_batches, "checked_losses": checked_losses, "language_model_matches": language_model_matches, "unit_norms": unit_norms,
    "rotary_positions": rotary_positions, "residual_means": residual_means, "reset_recurrence": reset_recurrence,
}
ORACLES = {
    "candidates": CANDIDATES, "parameter_draws": DRAWS, "seeds_until_failure": UNTIL_FAILURE, "good_trials": GOOD_TRIALS, "run_summary": RUN_SUMMARY, "probe_best": PROBE_BEST,
    "run_commands": COMMANDS, "sane_batches": SANE, "checked_losses": CHECKED_LOSSES, "language_model_matches": LM_MATCHES, "unit_norms": NORMS,
    "rotary_positions": ROTARY, "residual_means": RESIDUAL, "reset_recurrence": RECURRENCE,
}
