"""Checks of packed batches and losses, and samples for fine-tuning made of packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.metrics import LEAST_LOSS, is_finite

IGNORED = -100
SFT_COLUMNS = ("token_ids", "seq_ids", "position_ids", "sequence_starts", "target_loss_weights", "target_role_ids", "stp_span_starts", "stp_span_ends")


def is_sane(ids: Column, labels: Column, mask: Column, positions: Column, vocabulary: int) -> Column:
    """Whether ids lie in the vocabulary, labels do or are ignored, the mask is from 0 to 1 and positions aren't negative."""
    inside = lambda x: (x >= 0) & (x < vocabulary)
    return F.forall(ids, inside) & F.forall(labels, lambda x: (x == IGNORED) | inside(x)) & F.forall(mask, lambda x: is_finite(x.cast("double")) & (x >= 0) & (x <= 1)) & F.forall(positions, lambda x: x >= 0)


def checked_loss(loss: Column, name: str = "validation") -> Column:
    """The loss, 0 at least; one that isn't finite or is below zero by more than rounding fails the query."""
    return F.when(~is_finite(loss), F.raise_error(F.lit(f"the {name} loss isn't finite"))).when(loss < LEAST_LOSS, F.raise_error(F.lit(f"the {name} loss is negative"))).otherwise(F.greatest(loss, F.lit(0.0)))


def sft_sample(df: DataFrame, block: int, least: int = 3) -> DataFrame:
    """Packed rows as training samples: input_ids, labels, loss_mask, position_ids, sequence_start_mask, seq_ids, target_role_ids and spans.

    A target counts where it is of its input's sequence, with its weight; spans stay if they
    have ``least`` places and lie inside the block. Rows whose arrays aren't block + 1 long, or
    whose span arrays differ in length, fail the query.
    """
    arrays = SFT_COLUMNS[:6]
    right = F.lit(True)
    for c in arrays:
        right = right & (F.size(c) == block + 1)
    fault = F.when(~right, f"fields aren't {block + 1} long").when(F.size("stp_span_starts") != F.size("stp_span_ends"), "span starts and ends differ in length")
    ids = F.when(fault.isNull(), F.col("token_ids")).otherwise(F.raise_error(fault))
    head, tail = lambda c: F.slice(c, 1, block), lambda c: F.slice(c, 2, block)
    same = F.zip_with(head("seq_ids"), tail("seq_ids"), lambda a, b: (a == b) & (a >= 0))
    spans = F.zip_with("stp_span_starts", "stp_span_ends", lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    kept = F.filter(spans, lambda s: (s["end"] - s["begin"] >= least) & (s["begin"] >= 0) & (s["end"] <= block))
    rest = [c for c in df.columns if c not in SFT_COLUMNS]
    return df.withColumn("token_ids", ids).withColumn("_same", same).select(
        *rest, head("token_ids").alias("input_ids"),
        F.zip_with(tail("token_ids"), "_same", lambda t, s: F.when(s, t).otherwise(IGNORED)).alias("labels"),
        F.zip_with(tail("target_loss_weights"), "_same", lambda w, s: F.when(s, w).otherwise(0.0)).alias("loss_mask"),
        head("position_ids").alias("position_ids"), F.transform(head("sequence_starts"), lambda s, i: s | (i == 0)).alias("sequence_start_mask"),
        head("seq_ids").alias("seq_ids"), tail("target_role_ids").alias("target_role_ids"), kept.alias("spans"),
    )


def collate(df: DataFrame, batch: str | tuple[str, ...], order: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each batch (of one or several columns) with its rows' fields stacked in order; a batch is bounded by its size, so stack one that isn't in parts."""
    by = (batch,) if isinstance(batch, str) else batch
    # sort_array compares structs without a lambda; the generator keeps the sort from being copied to each use of a field
    rows = df.groupBy(*by).agg(F.collect_list(F.struct(order, *fields)).alias("_rows")).select(*by, F.explode(F.array(F.sort_array("_rows"))).alias("_rows"))
    return rows.select(*by, *(F.col(f"_rows.{f}").alias(f) for f in fields))


def register_tokens(vocabulary: DataFrame, wanted: list[str]) -> DataFrame:
    """vocabulary (token, id) with is_special; wanted tokens that it lacks get the next ids, in order. A wanted token with several ids raises ValueError."""
    own = vocabulary.select("token", F.col("id").cast("long").alias("id"))
    known = {r["token"]: r["n"] for r in own.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    several = sorted(t for t, n in known.items() if n > 1)
    if several:
        raise ValueError(f"tokens with several ids: {several}")
    missing = [t for t in dict.fromkeys(wanted) if t not in known]
    top = own.agg(F.max("id")).first()[0]
    first = -1 if top is None else top
    added = vocabulary.sparkSession.createDataFrame([(t, first + 1 + k) for k, t in enumerate(missing)], "token string, id long")
    return own.union(added).withColumn("is_special", F.col("token").isin(wanted))


def decode(rows: DataFrame, vocabulary: DataFrame, key: str, ids: str, skip_special: bool = False) -> DataFrame:
    """(key, text): the tokens of each row's ids in order, joined; unknown ids, and with skip_special special tokens, give nothing."""
    flat = rows.select(key, F.posexplode_outer(ids).alias("at", "id")).join(vocabulary, "id", "left")
    shown = F.when(F.coalesce("is_special", F.lit(False)) & F.lit(skip_special), "").otherwise(F.coalesce("token", F.lit("")))
    return flat.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("t")))), lambda x: x["t"]), "").alias("text"))
