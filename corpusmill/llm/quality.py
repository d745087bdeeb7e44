"""Quality rules, among them repetition inside a document measured on its suffix array.

The suffix array is over words and built by prefix doubling, many documents at a time: each
document ends with a word of its own and shares no word number with another, so no repeat
crosses documents. The common prefix of neighbouring suffixes follows from the ranks that the
doubling has kept at each power of two. A maximal repeated substring spans, from each of its
starts, the longest common prefix with either neighbour; the rules limit the part of the
words that such spans cover and the longest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.common import buffers, release_memory

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHUNK = 1 << 20
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")
_OWN = "_quality_"


@dataclass(frozen=True)
class Limits:
    """A text fails with fewer words than min_words, with over window_percent of its words in
    ``window``-word strings found twice, with over covered_percent in maximal repeats of at
    least ``repeat`` words, or with a repeat of over ``longest`` words."""

    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    repeat: int = 8
    covered_percent: int = 15
    longest: int = 50


def suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ. The last word of each document must be unique."""
    _, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    open_, out, step = np.flatnonzero(counts[inverse] > 1), [rank], 1
    while len(open_):
        head, tail = rank[open_], rank[open_ + step]
        order = np.argsort(head * (len(words) + 1) + tail, kind="stable")
        head, tail, open_ = head[order], tail[order], open_[order]
        at = np.arange(len(open_))
        new_head = np.concatenate(([True], head[1:] != head[:-1]))
        new = new_head | np.concatenate(([True], tail[1:] != tail[:-1]))
        rank = rank.copy()
        rank[open_] = head + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_head, at, 0))
        open_ = open_[~(new & np.concatenate((new[1:], [True])))]
        out.append(rank)
        step *= 2
    return out


def repeat_lengths(words: np.ndarray, least: int) -> np.ndarray:
    """For each position the words it shares with its suffix array neighbours, 0 where that is below least."""
    ranks = suffix_ranks(words)
    depth = int(np.log2(least))
    out = np.zeros(len(words), np.int64)
    if depth >= len(ranks):
        return out
    order = np.argsort(ranks[-1])
    same = ranks[depth][order[1:]] == ranks[depth][order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    length = np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        length += (ranks[k][left + length] == ranks[k][right + length]).astype(np.int64) << k
    length[length < least] = 0
    out[left] = length
    out[right] = np.maximum(out[right], length)
    return out


def _covered(lengths: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(lengths)
    change = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths[at], -1)
    return np.cumsum(change)[:-1] > 0


def measure(texts: list[bytes], limits: Limits) -> np.ndarray:
    """One row of _NAMES for each text."""
    out = np.zeros((len(texts), len(_NAMES)), np.int64)
    words, ends, known = [], [], 0
    for k, text in enumerate(texts):
        found: dict[bytes, int] = {}
        own = text.split()
        words.extend([known + found.setdefault(w, len(found)) for w in own])
        known += len(found) + 1
        words.append(known - 1)
        ends.append(len(words))
        lines = [line for line in text.split(b"\n") if line.strip()]
        out[k, 0], out[k, 3] = len(own), len(lines) - len(set(lines))
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for column, hit in ((1, ~_SEPARATOR[data] & ((data & 0xC0) != 0x80)), (2, _SYMBOL[data])):
        out[:, column] = np.diff(np.concatenate(([0], np.cumsum(hit)))[edges])
    lengths = repeat_lengths(np.array(words, np.int64), limits.window)
    starts = np.array([0, *ends[:-1]])
    windows = np.where(lengths >= limits.window, limits.window, 0)
    longer = np.where(lengths >= limits.repeat, lengths, 0)
    out[:, 4] = np.add.reduceat(_covered(windows).astype(np.int64), starts)
    out[:, 5] = np.add.reduceat(_covered(longer).astype(np.int64), starts)
    out[:, 6] = np.maximum.reduceat(lengths, starts)
    return out


def _measured(limits: Limits):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found, a = [], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
                found.append(measure([data[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)], limits))
                a = b
            rows = np.concatenate([*found, np.zeros((0, len(_NAMES)), np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(_NAMES)))], [*batch.schema.names, *(_OWN + n for n in _NAMES)])

    return measured


def _judged(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows (with a string column text) with one column more for each count, base_failed and kept, under names of our own."""
    added = [StructField(_OWN + n, LongType()) for n in _NAMES]
    found = rows.mapInArrow(_measured(limits), StructType([*rows.schema.fields, *added]))
    c = {n: F.col(_OWN + n) for n in _NAMES}
    failed = (c["n_words"] < limits.min_words) | (100 * c["n_repeat_words"] > limits.window_percent * c["n_words"])
    repeats = (100 * c["n_covered_words"] > limits.covered_percent * c["n_words"]) | (c["longest_repeat"] > limits.longest)
    return found.withColumn(_OWN + "base_failed", failed).withColumn(_OWN + "kept", ~failed & ~repeats)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id of every row of docs (doc_id, text) with its counts, base_failed and kept.

    Words are runs without ASCII white space; null and empty texts have none and fail. Lines
    count as equal only byte by byte. Repeated rows are judged alike, each on its own; a null
    doc_id is passed on. A text of any length is measured whole, in memory that grows with its
    words; rules at exactly their limit pass. Other columns are ignored, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(rows, limits).select("doc_id", *(F.col(_OWN + n).alias(n) for n in (*_NAMES, "base_failed", "kept")))


def quality_filter(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names; the rest is as for ``quality_rules``."""
    names = ["text" if c == "text" else f"_carried_{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names).withColumn("text", F.col("text").cast("string"))
    return _judged(rows, limits).where(F.col(_OWN + "kept")).select(*names).toDF(*docs.columns)
