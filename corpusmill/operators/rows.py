"""Deduplication, splits, deterministic shuffles, shards and samples of ordered tables."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.intervals import with_offsets

# The constants of splitmix64.
_GOLDEN, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def dedup_first(df: DataFrame, text: str = "text", order: tuple[str, ...] = ("stage_ord", "row_idx")) -> DataFrame:
    """The first row of each text, by order. One aggregate with map-side combine: the input is read once, and copies of a text meet as one row from each task."""
    first = df.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def file_seed(seed: int, name: str) -> int:
    """A shard's seed, from its file name."""
    mixed = seed ^ int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _halves(x: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a long."""
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _of_halves(high: Column, low: Column) -> Column:
    """A long of sums that may exceed 32 bits: what low carries goes to high, and what is above 64 bits goes."""
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrapped_sum(x: Column, y: int) -> Column:
    """x + y on 64 bits, without overflow."""
    high, low = _halves(x)
    return _of_halves(high + (y >> 32 & 0xFFFFFFFF), low + (y & 0xFFFFFFFF))


def wrapped_product(x: Column, y: int) -> Column:
    """x * y on 64 bits, without overflow: y is multiplied in by 16 bits at a time."""
    high, low = _halves(x)
    a, b, c, d = (y >> k & 0xFFFF for k in (0, 16, 32, 48))
    first, second = low * a, low * b
    upper = F.shiftrightunsigned(second, 16) + low * c + high * a + F.shiftleft((low * d + high * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return _of_halves(upper, first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16))


def splitmix64(df: DataFrame, value: Column, name: str = "key") -> DataFrame:
    """df with splitmix64 of a long, as a signed long."""
    out = df.withColumn(name, wrapped_sum(value, _GOLDEN))
    for bits, factor in ((30, _FIRST), (27, _SECOND)):
        out = out.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, bits))).withColumn(name, wrapped_product(F.col(name), factor))
    return out.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, 31)))


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of an unsigned 64-bit key, held as a long: key * buckets / 2 ** 64, so buckets are ranges of keys in order; ``buckets`` is below 2 ** 31."""
    high, low = _halves(F.col(key))
    return F.shiftrightunsigned(high * buckets + F.shiftrightunsigned(low * buckets, 32), 32).cast("int")


def unsigned_order(key: str = "key") -> Column:
    """Sorts like the unsigned value of a long."""
    return F.col(key).bitwiseXOR(F.lit(-(1 << 63)))


def shuffle_rows(df: DataFrame, seed: int, name: str, order: str = "row_idx") -> DataFrame:
    """df in a random order that depends on nothing but seed, file name and row number: a range sort by each row's key."""
    keyed = splitmix64(df, wrapped_sum(F.col(order), file_seed(seed, name)), "_key")
    return keyed.orderBy(unsigned_order("_key")).drop("_key")


def split_by_hash(df: DataFrame, order: str, ratio: float, seed: int) -> DataFrame:
    """df with is_val: max(1, round half even of n * ratio) rows, those with the smallest hash of seed and order.

    The threshold is a top-k over hashes only, no row number over the table.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string"))))
    n = df.count()
    k = min(n, max(1, round(n * ratio)))
    last = hashed.select("_hash", order).orderBy("_hash", order).offset(k - 1).limit(1) if n else None
    edge = last.first() if last is not None else None
    return hashed.withColumn("is_val", F.struct("_hash", order) <= F.struct(F.lit(edge[0]), F.lit(edge[1]).cast(df.schema[order].dataType)) if edge else F.lit(False)).drop("_hash")


def shard(df: DataFrame, count: int, index: int, order: str = "row_idx") -> DataFrame:
    """Every count-th row, from ``index`` on."""
    return df.where(F.pmod(F.col(order), F.lit(count)) == index)


def shard_rows(n: Column, count: int, index: Column) -> Column:
    """Rows of shard ``index`` of a table of n rows."""
    return F.when(n > index, F.floor((n - 1 - index) / count) + 1).otherwise(F.lit(0)).cast("long")


def full_batches(df: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """df with its batch number, without a last batch that isn't full."""
    n = df.count() // size * size
    return df.withColumn("batch", F.floor(F.col(order) / size)).where(F.col(order) < n)


def repeat_epochs(df: DataFrame, epochs: int, seed: int, order: str = "row_idx") -> DataFrame:
    """Every row once in each epoch; ``place`` orders an epoch, another way in each."""
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return every.withColumn("place", F.xxhash64(F.lit(seed) + F.col("epoch") * 1009, order))


def stage_union(frames: list[DataFrame], order: str, limit: int | None = None) -> DataFrame:
    """The frames one after the other, with stage_ord; at most ``limit`` rows in that order."""
    out = None
    for k, frame in enumerate(frames):
        own = frame.withColumn("stage_ord", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy("stage_ord", order).limit(limit) if limit is not None else out


def _shots(n: int, k: int, seed: int):
    def shots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's own generator picks places among all others."""
        for batch in batches:
            rows = []
            for item, at in zip(batch.column("item").to_pylist(), batch.column("at").to_pylist(), strict=True):
                picked = random.Random(seed + at).sample(range(n - 1), min(k, n - 1))
                rows += [(item, rank, p + (p >= at)) for rank, p in enumerate(picked, 1)]
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "rank", "to"])

    return shots


def few_shot(items: DataFrame, k: int, seed: int = 1234, item: str = "item_id") -> DataFrame:
    """(item, rank, shot): k other items for each item (whole numbers, each once), or all others if there are fewer.

    Items are numbered in their order, and item number i samples with a generator that starts
    from seed + i, so its shots depend on nothing but i and the number of items. No task sees
    more of the items than its own, and no pairs of all items are formed.
    """
    numbered = with_offsets(items.select(F.col(item).cast("long").alias("item")), F.lit(1), "item", name="at")
    n = items.count()
    picks = numbered.mapInArrow(_shots(n, k, seed), "item long, rank long, to long") if n > 1 and k > 0 else numbered.select("item", F.col("at").alias("rank"), F.col("at").alias("to")).limit(0)
    there = numbered.select(F.col("item").alias("shot"), F.col("at").alias("to"))
    return picks.join(there, "to").select(F.col("item").alias(item), "rank", "shot")


def prefix_split(df: DataFrame, ratio: float, order: str = "row_idx") -> DataFrame:
    """df with is_train: the first ratio of the rows, by their numbers from 0."""
    return df.withColumn("is_train", F.col(order) < int(df.count() * ratio))


def sft_split(df: DataFrame, order: str, ratio: float) -> DataFrame:
    """df with is_val: of n rows in a shuffled ``order`` the first min(max(1, round half even of n * ratio), n - 1), none for a ratio of 0; other ratios than [0, 1) raise ValueError."""
    if not 0 <= ratio < 1:
        raise ValueError("the ratio must be in [0, 1)")
    n = df.count() if ratio else 0
    k = min(max(1, round(n * ratio)), max(0, n - 1)) if n else 0
    edge = df.select(order).orderBy(order).offset(k - 1).limit(1).first() if k else None
    return df.withColumn("is_val", F.col(order) <= F.lit(edge[0]).cast(df.schema[order].dataType) if edge else F.lit(False))


def limit_by_source(df: DataFrame, most: int, order: str = "row_idx") -> DataFrame:
    """The first ``most`` rows of each source, by their numbers from 0 (which the readers give to accepted rows)."""
    return df.where(F.col(order) < most)


def _popped(seed: int, epoch: int, buffer: int):
    def popped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, index) come sorted; a full buffer gives one of its rows at random for each that comes, and what is left at the end is shuffled."""
        own, held, place, draw = None, [], 0, random.Random()

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["shard", "place", "index"])

        for batch in batches:
            out = []
            for shard, index in zip(batch.column("shard").to_pylist(), batch.column("index").to_pylist(), strict=True):
                if shard != own:
                    draw.shuffle(held)
                    out += [(own, place + k, x) for k, x in enumerate(held)]
                    own, held, place, draw = shard, [], 0, random.Random(seed + epoch * 1009 + shard)
                held.append(index)
                if len(held) >= buffer:
                    out.append((own, place, held.pop(draw.randrange(len(held)))))
                    place += 1
            if out:
                yield batch_of(out)
        if held:
            draw.shuffle(held)
            yield batch_of([(own, place + k, x) for k, x in enumerate(held)])

    return popped


def buffered_order(df: DataFrame, count: int, seed: int, epoch: int = 0, buffer: int = 10_000, order: str = "row_idx") -> DataFrame:
    """df (rows numbered from 0 by ``order``) with shard, row number modulo ``count``, and place, where a row comes out of its shard's buffer.

    A shard's generator is seeded by seed, epoch and shard, and its buffer of ``buffer`` rows is
    carried through the shard in order. Only row numbers go through it, by shards and not by
    tasks, so places don't depend on the table's partitions; the rows then join them.
    """
    at = df.select(F.pmod(F.col(order), F.lit(count)).cast("long").alias("shard"), F.col(order).cast("long").alias("index"))
    places = at.repartition("shard").sortWithinPartitions("shard", "index").mapInArrow(_popped(seed, epoch, buffer), "shard long, place long, index long")
    return df.join(places, F.col(order) == F.col("index")).drop("index")
