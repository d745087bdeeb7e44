"""Fine-tuning records packed into blocks, with the spans of their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import chat, intervals
from corpusmill.sources.sinks import written

EXTRA = ("target_loss_weights", "target_role_ids")


def _spans_in_windows(measured: DataFrame, block: int, order: str) -> DataFrame:
    """(window, begin, end) of rows (order, _n tokens, _spans)."""
    placed = intervals.with_offsets(measured.select(order, "_n", "_spans"), F.col("_n"), order)
    spans = placed.select("offset", F.explode("_spans").alias("s"))
    spans = spans.select((F.col("offset") + F.col("s.begin")).alias("begin"), (F.col("offset") + F.col("s.end")).alias("end"))
    return intervals.clip_spans(spans, block, measured.agg(F.sum("_n")).first()[0] or 0)


def _measured(rows: DataFrame, order: str, encoded: str, **fields: str) -> DataFrame:
    """Each record's size and answers, and these fields of its tokens, written: offsets, windows and totals read them, and records are encoded once."""
    once = rows.select(order, F.explode(F.array(encoded)).alias("_e"))  # a generator, so that no field encodes again
    return written(once.select(order, F.size("_e").alias("_n"), chat.answer_spans(F.col("_e")).alias("_spans"), *(F.col(f"_e.{f}").alias(n) for n, f in fields.items())), "sft-records")


def answer_spans_in_windows(rows: DataFrame, block: int, order: str = "row_idx", encoded: str = "e") -> DataFrame:
    """(window, begin, end): the answers of encoded records, laid end to end in order, cut to windows of ``block`` inputs."""
    return _spans_in_windows(_measured(rows, order, encoded), block, order)


def pack_sft(rows: DataFrame, block: int, order: str = "row_idx", encoded: str = "e") -> DataFrame:
    """Encoded records (``chat.encode_sft``) in order as packed rows, the last one padded, with stp_span_starts and stp_span_ends of the answers in each."""
    measured = _measured(rows, order, encoded, tokens="tok", target_loss_weights="w", target_role_ids="role")
    packed = intervals.pack_tokens(measured.select(order, "_n", "tokens", *EXTRA), block, order, pad=0, extra=EXTRA, size=F.col("_n"))
    spans = _spans_in_windows(measured, block, order).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_s"))
    ends = {c: F.coalesce(F.col(f"_s.{f}").cast("array<int>"), F.array().cast("array<int>")) for c, f in (("stp_span_starts", "begin"), ("stp_span_ends", "end"))}
    return packed.join(spans, "window", "left").withColumns(ends).drop("_s")
