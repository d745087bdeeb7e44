"""Packing of token sequences into as few fixed-size blocks as possible, by bin completion.

Only the lengths matter, and there are at most ``size`` different ones, so the plan is made on
their histogram. Bin completion takes the largest length that is left and tries the
undominated ways to fill the rest of its block, one by one in order of waste. The first
incumbent is best-fit decreasing. A branch-and-bound search runs over the choices from the
largest length on, and leaves a branch once its waste shows that it can't use fewer blocks than
the incumbent. Where it doesn't end, the incumbent is completed again in parts: a few blocks,
the emptiest among them, are taken apart and filled by completion, and stay so if that gathers
the waste in fewer of them. A filling is laid out as often as its lengths last, so the plan's
size follows the number of different lengths and not that of documents. The gap to the lower
bound is logged.

Documents then find their place without a loop: each is numbered among those of its length,
and the plan gives ranges of these numbers their blocks and offsets.
"""

from __future__ import annotations

import logging
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import parts_of, release_memory, shared_path, spread
from corpusmill.llm.tokens import shared_encoder, with_end

_FEW = 8
_LOG = logging.getLogger(__name__)
Plan = list[tuple[tuple[int, ...], int]]  # lengths of a block's items and how many blocks are filled so
_PIECES = "doc_id long, piece int, start long, length int, ids array<int>, ids_crc32 long, part int, number long"


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing, many equal items at a time."""
    room: dict[tuple[int, ...], int] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fitting = sorted((k for k in room if size - sum(k) >= length), key=sum, reverse=True)
        for k in fitting:
            if not left:
                break
            n = min(left, room[k])
            times = (size - sum(k)) // length
            used = min(times, -(-left // n))
            n = min(n, left // used)
            room[k] -= n
            if not room[k]:
                del room[k]
            room[k + (length,) * used] = room.get(k + (length,) * used, 0) + n
            left -= n * used
        while left:
            used = min(size // length, left)
            n = left // used
            key = (length,) * used
            room[key] = room.get(key, 0) + n
            left -= n * used
    return list(room.items())


def _reach(lengths: list[int], counts: dict[int, int], total: int, most: int) -> list[int]:
    """For each i, a bit set of the totals that lengths[i:] have multisets of; with ``most``, one row of bits for each number of items up to it."""
    row = 2 * total + 2 if most else 0
    mask = (1 << (total + 1)) - 1
    mask = sum(mask << (m * row) for m in range(most + 1)) if most else mask
    reach = [1]
    for x in reversed(lengths):
        bits, n, step = reach[-1], min(counts[x], total // x, most or total), 1
        while n:
            step = min(step, n)
            bits |= bits << (step * (x + row)) & mask
            n, step = n - step, 2 * step
        reach.append(bits)
    return reach[::-1]


def _sums(lengths: list[int], counts: dict[int, int], total: int) -> Iterator[tuple[int, ...]]:
    """Every multiset of lengths (in falling order, each at most as often as counted) of exactly ``total``, ordered as by ``_key``."""

    def pick(i: int, left: int, items: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        while i < len(lengths) and reach[i] >> (left + items * row) & 1:
            x, i = lengths[i], i + 1
            for n in range(min(counts[x], left // x, items if row else left), 0, -1):
                if reach[i] >> (left - n * x + (items - n) * row) & 1:
                    for rest in pick(i, left - n * x, items - n if row else 0):
                        yield (x,) * n + rest

    row, reach = 0, _reach(lengths, counts, total, 0)
    if not reach[0] >> total & 1:
        return
    if not total:
        yield ()
        return
    row = 2 * total + 2
    for few, most in ((0, 2), (2, _FEW)):
        reach = _reach(lengths, counts, total, most)
        for items in range(few + 1, most + 1):
            yield from pick(0, total, items)
    row, reach = 0, _reach(lengths, counts, total, 0)
    yield from (x for x in pick(0, total, 0) if len(x) > _FEW)


def _key(filling: tuple[int, ...]) -> tuple:
    """Fillings are tried in falling order of this: least waste first, of equal waste those with fewer items (up to _FEW), then those with larger ones."""
    return sum(filling), -min(len(filling), _FEW + 1), filling


def candidates(counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """All fillings of ``room`` that leave out no item their waste has room for, by falling ``_key`` (of equal waste, without the items that are in all)."""
    lengths = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    small, forced = len(lengths), 0  # lengths[small:] fit into the waste, so all of them are in
    for waste in range(room + 1):
        if small and lengths[small - 1] <= waste:
            small -= 1
            forced += lengths[small] * counts[lengths[small]]
        if forced > room - waste:
            return
        tail = tuple(x for x in lengths[small:] for _ in range(counts[x]))
        for filling in _sums(lengths[:small], counts, room - waste - forced):
            yield filling + tail


def dominated(filling: tuple[int, ...], counts: dict[int, int], room: int) -> bool:
    """Whether an item left out could take the place of some of the filling: it fills more, or as much as several."""
    one, several, waste = 0, 0, room - sum(filling)  # totals of one and of several items of the filling
    for x in filling:
        several |= (several | one) << x
        one |= 1 << x
    spare = 0
    for x, n in counts.items():
        if n > filling.count(x):
            spare |= 1 << x
    return bool((_above(one | several | 1, waste) | several) & spare)


def _above(sums: int, waste: int) -> int:
    """sums with 1 to ``waste`` added."""
    out, done = sums << 1 if waste else 0, 1
    while done < waste:
        step = min(done, waste - done)
        out |= out << step
        done += step
    return out


def _used(counts: dict[int, int], items: tuple[int, ...]) -> int:
    return min(counts[x] // items.count(x) for x in set(items))


def _branches(left: dict[int, int], size: int, branch: tuple | None) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """The ways to go on at a node: blocks of the largest length and an undominated filling, and how many of them; None for a candidate that is none.

    Blocks with equal largest items can come in any order, so they come in that of the candidates.
    """
    largest = max(left)
    rest = left | {largest: left[largest] - 1}
    before = branch[1][0] if branch and branch[1][0][0] == largest else None
    for filling in candidates(rest, size - largest):
        items = (largest, *filling)
        if before and _key(items) >= _key(before) or dominated(filling, rest, size - largest):
            yield None
            continue
        for n in range(_used(left, items), 0, -1):
            yield items, n


def _completed(counts: dict[int, int], size: int) -> Plan:
    """Blocks around the largest length left, each with its least wasteful filling of fewest items."""
    out: dict[tuple[int, ...], int] = {}
    while counts:
        largest = max(counts)
        items = (largest, *next(candidates(_without(counts, (largest,), 1), size - largest)))
        n = _used(counts, items)
        out[items] = out.get(items, 0) + n
        counts = _without(counts, items, n)
    return list(out.items())


def _gathered(plan: Plan) -> tuple[int, int]:
    """Larger for fewer blocks, then for waste that lies in fewer of them."""
    return -sum(n for _, n in plan), sum(n * sum(items) ** 2 for items, n in plan)


def completed_in_parts(plan: Plan, size: int, least: int, rounds: int, seed: int = 1, most: int = 5) -> Plan:
    """The plan after ``rounds`` attempts, or at ``least`` blocks.

    An attempt takes apart a block of each of some kinds: the emptiest kind, up to ``most`` of
    those with waste and up to ``most`` of those with several items. It is made for as many blocks
    as the kinds have at least, so a plan of many blocks needs no more attempts than one of few.
    """
    bins: dict[tuple[int, ...], int] = {}
    for items, n in plan:
        kind = tuple(sorted(items, reverse=True))
        bins[kind] = bins.get(kind, 0) + n
    rng, blocks = random.Random(seed), sum(bins.values())
    while blocks > least and rounds:
        rounds -= 1
        wasteful = [k for k in bins if sum(k) < size]
        several = [k for k in bins if len(k) > 1]
        chosen = {min(wasteful, key=sum)}
        for kinds in (wasteful, several):
            chosen |= set(rng.sample(kinds, min(len(kinds), rng.randint(1, most))))
        chosen = sorted(chosen)
        found = _completed(dict(Counter(x for k in chosen for x in k)), size)
        if _gathered(found) < _gathered([(k, 1) for k in chosen]):
            continue
        n = min(bins[k] for k in chosen)
        for k in chosen:
            bins[k] -= n
            if not bins[k]:
                del bins[k]
        for items, times in found:
            kind = tuple(sorted(items, reverse=True))
            bins[kind] = bins.get(kind, 0) + n * times
        blocks = sum(bins.values())
    return list(bins.items())


def bin_completion(counts: dict[int, int], size: int, nodes: int = 5_000, rounds: int = 3_000) -> Plan:
    """A plan for counts (length -> items, lengths up to size): optimal if the search ends within ``nodes`` steps.

    If it doesn't, parts of the best plan found are completed again, up to ``rounds`` times. A
    step is a candidate looked at or a branch taken. Every undominated filling is tried, each
    as often as it lasts and then less often. ``gap`` tells how far a plan may be from the optimum.
    """
    counts = {k: n for k, n in counts.items() if n}
    incumbent = best_fit(counts, size)
    best = sum(n for _, n in incumbent)
    total = sum(k * n for k, n in counts.items())
    least = -(-total // size)
    stack = [[counts, None, 0, 0, None, 0]]  # lengths left, the branch as (branch above, (items, blocks)), its blocks, waste, ways on and how many were taken
    while stack and best > least and nodes:
        left, branch, bins, waste, ways, taken = stack[-1]
        if ways is None:
            ways = stack[-1][4] = islice(_branches(left, size, branch), taken, None)
        way = next(ways, ())
        stack[-1][5] += 1
        if way == ():
            stack.pop()
            continue
        nodes -= 1
        if way is None:
            continue
        items, n = way
        waste += n * (size - sum(items))
        if waste > (best - 1) * size - total:  # no room for fewer blocks than the incumbent's
            if n == 1:
                stack.pop()  # what comes next wastes as much or more
            continue
        left, branch, bins = _without(left, items, n), (branch, way), bins + n
        if left:
            stack.append([left, branch, bins, waste, None, 0])
            if len(stack) > 32:  # their tables are large; made again when the search comes back
                stack[-33][4] = None
        elif bins < best:
            incumbent, best = _plan(branch), bins
    return completed_in_parts(incumbent, size, least, rounds) if stack and best > least else incumbent


def gap(plan: Plan, size: int) -> int:
    """Blocks of a plan beyond the total of its items over ``size``, rounded up; no plan has fewer than that."""
    return sum(n for _, n in plan) - -(-sum(n * sum(items) for items, n in plan) // size)


def _without(left: dict[int, int], items: tuple[int, ...], n: int) -> dict[int, int]:
    left = dict(left)
    for x in items:
        left[x] -= n
        if not left[x]:
            del left[x]
    return left


def _plan(branch: tuple | None) -> Plan:
    plan = []
    while branch:
        branch, filling = branch
        plan.append(filling)
    return plan[::-1]


def plan_rows(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end, first block, offset): where items of a length go, by their numbers among that length."""
    rows, next_, block = [], {}, 0
    for items, n in plan:
        offset = 0
        for x in items:
            at = next_.get(x, 0)
            rows.append((x, at, at + n, block, offset))
            next_[x] = at + n
            offset += x
        block += n
    return rows


def pieces_of(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many ids: each piece's document, number, first id and length. Only longer documents are cut, and the first of their pieces may be shorter."""
    count = -(-lengths // size)
    doc, piece = np.repeat(np.arange(len(lengths)), count), spread(np.zeros(len(lengths), np.int64), count)
    first = lengths - (count - 1) * size
    return doc, piece, np.where(piece > 0, first[doc] + (piece - 1) * size, 0), np.where(piece > 0, size, first[doc])


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each item among those of its length, from seen[length] on; seen is counted up."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def _cut(path: str, style: str, end_id: int, size: int, part_bytes: int = 2 << 20):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = shared_encoder(path, style), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        release_memory(encode)
        for batch in batches:
            at = 0
            for texts in parts_of(batch.column("text"), part_bytes):
                flat, offsets = with_end(*encode(texts.cast(pa.large_string())), end_id)
                doc, piece, start, length = pieces_of(np.diff(offsets), size)
                edges = np.append(offsets[doc] + start, len(flat))
                raw = memoryview(flat.astype("<u4", copy=False).view(np.uint8))
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * edges[:-1]).tolist(), (4 * edges[1:]).tolist(), strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view("<i4")))
                docs = batch.column("doc_id").slice(at, len(texts)).take(pa.array(doc))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), ids, pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(_numbered(length, seen))],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "number"],
                )
        encode.forget()

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str, style: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids of docs (doc_id, text), each document followed by end_id, written to the shared folder.

    Only longer documents are cut; the first of their pieces may be shorter, the others are
    full. ``number`` counts the pieces of equal length within ``part``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    to = shared_path(docs.sparkSession, "pieces")
    rows.mapInArrow(_cut(tokenizer, style, end_id, size), _PIECES).write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.schema(_PIECES).parquet(to)


def pack(pieces: DataFrame, size: int, most_rows: int = 200_000) -> DataFrame:
    """pieces (length, part, number, ...) with sequence_id and offset, their places in blocks of ``size``, and the plan's ``gap``.

    The histogram that is collected has at most ``size`` rows. The plan and the counts of each
    part are broadcast up to most_rows rows and shuffled beyond. Every piece gets a place; an empty table gives none.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if per_part.count() <= most_rows:
        bases = F.broadcast(bases)
    found = bin_completion(counts, size)
    if gap(found, size):
        _LOG.warning("%d blocks of %d, %d more than the lower bound", sum(n for _, n in found), size, gap(found, size))
    rows = plan_rows(found)
    plan = spark.createDataFrame(rows, "length int, low long, high long, block long, offset long")
    if len(rows) <= most_rows:
        plan = F.broadcast(plan)
    numbered = pieces.join(bases, ["length", "part"]).withColumn("number", F.col("number") + F.col("base"))
    inside = (numbered["length"] == plan["length"]) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    return numbered.join(plan, inside).select(*(numbered[c] for c in pieces.columns if c not in ("part", "number")), (F.col("block") + F.col("number") - F.col("low")).alias("sequence_id"), "offset", F.lit(gap(found, size)).cast("long").alias("gap"))


def best_fit_packing(docs: DataFrame, tokenizer: str, style: str, end_id: int, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset and gap of every piece of docs (doc_id, text).

    Null and empty texts are one piece, their end id. Repeated rows, and rows with a null
    doc_id, are packed like any other. A text of any length is encoded whole and cut into
    pieces. Pieces of equal length are alike to the plan; which of them goes where follows
    from their numbers. ``gap`` is the same in all rows: the sequences that the plan has beyond
    the lower bound, 0 for a plan that is known to be the best. Other columns are ignored, and
    an empty table gives an empty result.
    """
    return pack(cut_pieces(docs, tokenizer, style, end_id, size), size)
