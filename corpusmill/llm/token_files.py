"""Token ids in binary shards, each with a minimal perfect hash index from document key to record.

A shard is one binary value, kept uncompressed:

    magic "TOKSHRD2", then eight little-endian 64-bit numbers: keys, records, ids, bytes an id
    takes, levels, 64-bit words of the index bits, 0, 0
    levels: 64-bit sizes of the index levels in bits
    index bits: 64-bit words, lowest bit first
    ranks: 32 bits for each word, the number of bits set before it; padded to 8 bytes
    fingerprints: 32 bits for each slot; heads: 32-bit number of the first record of each
    slot's key; both padded to 8 bytes
    offsets: 64-bit first id of each record, and one past the last
    keys: 64-bit key of each record, ascending, for scans
    payload: the raw ids, 16 bits each if all fit, else 32

The index holds no keys. Level by level each key that is still unplaced hashes to one bit;
bits that exactly one key hits are set, and keys that collide go on to the next level. A key's
slot is the number of bits set before its own, so n keys have the slots 0 to n - 1. A lookup
reads a few words in place - a bit for each level, one rank, one fingerprint, one head, two
offsets - whatever the shard's size; opening a shard reads its header only. The slot's stored
fingerprint tells keys that aren't in the shard, but for one in 2**32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import NO_ID, U64, cut, ids_of, mixed, parts_of, shared_path, spread, text_bytes
from corpusmill.llm.tokens import shared_encoder, with_end

MAGIC = b"TOKSHRD2"
_SHARDS = "shard long, first_key long, last_key long, n_records long, n_ids long, body binary"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mixed(keys.astype(np.int64).view(U64) ^ U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def build_index(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, words of bits and ranks of a minimal perfect hash of distinct int64 keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = (_hash(left, len(sizes) + 1) % U64(size)).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(hits == 1)
        left = left[hits[at] != 1]
    words = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view("<u8")
    return sizes, words, (np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype("<u4")


def find_slots(keys: np.ndarray, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has it. A key that wasn't indexed may get any slot."""
    slots, base = np.full(len(keys), -1), 0
    for level, size in enumerate(sizes):
        at = base + (_hash(keys, level + 1) % U64(size)).astype(np.int64)
        word, bit = words[at >> 6], (at & 63).astype(U64)
        rank = ranks[at >> 6] + np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
        slots = np.where((slots < 0) & ((word >> bit & U64(1)) == 1), rank.astype(np.int64), slots)
        base += size
    return slots


def _padded(*arrays: np.ndarray) -> Iterator[bytes]:
    for x in arrays:
        yield x.tobytes()
        yield b"\0" * (-x.nbytes % 8)


def write_shard(keys: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """A shard of records in ascending key order; record i has ids[offsets[i]:offsets[i + 1]]. Rows that repeat a key stay together."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    distinct, first = np.unique(keys, return_index=True)
    sizes, words, ranks = build_index(distinct)
    slots = find_slots(distinct, sizes, words, ranks)
    fingerprints, heads = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    fingerprints[slots], heads[slots] = (_hash(distinct, 0) >> U64(32)).astype("<u4"), first
    head = np.array([len(distinct), len(keys), len(ids), width, len(sizes), len(words), 0, 0], "<i8")
    return MAGIC + b"".join(_padded(head, np.array(sizes, "<i8"), words, ranks, fingerprints, heads, offsets.astype("<i8"), keys.astype("<i8"))) + ids.astype(f"<u{width}").tobytes()


class Shard:
    """Keyed access to one shard, without a copy of it."""

    def __init__(self, body: bytes) -> None:
        if body[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, records, ids, width, levels, words = np.frombuffer(body, "<i8", 6, 8).tolist()
        at = 72

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(body, kind, count, at)
            at += -(-found.nbytes // 8) * 8
            return found

        self.sizes = take("<i8", levels).tolist()
        self.words, self.ranks = take("<u8", words), take("<u4", words)
        self.fingerprints, self.heads = take("<u4", n), take("<u4", n)
        self.offsets, self.keys, self.payload = take("<i8", records + 1), take("<i8", records), take(f"<u{width}", ids)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 for keys that aren't here."""
        slots = find_slots(keys, self.sizes, self.words, self.ranks)
        if not len(self.fingerprints):
            return slots
        known = (slots >= 0) & (self.fingerprints[slots] == (_hash(keys, 0) >> U64(32)).astype("<u4"))
        return np.where(known, self.heads[slots].astype(np.int64), -1)

    def ids(self, record: int) -> np.ndarray:
        return self.payload[self.offsets[record] : self.offsets[record + 1]]


def _encoded(path: str, style: str, end_id: int, shard_bytes: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys, ids, held, part = shared_encoder(path, style), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            own, flat = np.concatenate(keys), np.concatenate([x for x, _ in ids])
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x) for _, x in ids]))))
            row = [(TaskContext.get().partitionId() << 32) + part, own[0], own[-1], len(own), len(flat), write_shard(own, flat, offsets)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "first_key", "last_key", "n_records", "n_ids", "body"])

        for batch in batches:
            at = 0
            for texts in parts_of(batch.column("text").cast(pa.large_string()), shard_bytes // 2):
                found, ends = with_end(*encode(texts), end_id)
                keys.append(ids_of(batch.column("key").slice(at, len(texts))))
                ids.append((found, ends))
                at, held = at + len(texts), held + found.nbytes
                if held >= shard_bytes:
                    yield flush()
                    keys, ids, held, part = [], [], 0, part + 1
        if keys:
            yield flush()
        encode.forget()

    return encoded


def write_token_files(docs: DataFrame, to: str, tokenizer: str, style: str, end_id: int, partition_bytes: int = 24 << 20, shard_bytes: int = 8 << 20) -> None:
    """Write the ids of docs (doc_id, text) to the folder ``to`` in ascending doc_id order, each document followed by end_id.

    Null texts have no ids but the end. A null doc_id gets the largest key. Rows that repeat a
    doc_id keep their records, in the order of their texts; so many that one partition is too
    small for them are dealt to several by their texts' beginnings. A text of any length is one
    record, and a shard ends after the record that fills it. An empty table writes no shard.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("text").cast("string").alias("text"))
    parts = text_bytes(rows, "text") // partition_bytes + 1
    ordered = rows.repartitionByRange(parts, F.col("key"), F.substring("text", 1, 16)).sortWithinPartitions("key", "text")
    ordered.mapInArrow(_encoded(tokenizer, style, end_id, shard_bytes), _SHARDS).write.option("compression", "none").parquet(to)


def shard_starts(shards: DataFrame, group: int = 4096) -> DataFrame:
    """(shard, start): the ids before each shard. Sums go over groups of partitions first, so no task sees all shards of a large table."""
    counts = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part")).withColumn("group", (F.col("part") / group).cast("long"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(groups, "group").select("shard", (F.col("base") + F.col("own")).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, body in zip(batch.column("start").to_pylist(), batch.column("body"), strict=True):
            shard = Shard(body.as_buffer())
            heads = shard.find(shard.keys)
            again = np.arange(len(heads)) - np.searchsorted(shard.keys, shard.keys)  # earlier records of the same key
            records = heads + again
            lengths = shard.offsets[records + 1] - shard.offsets[records]
            crc = [zlib.crc32(shard.ids(r).astype("<u4")) for r in records.tolist()]
            lost = (heads < 0) | (shard.keys[records] != shard.keys)
            if lost.any():
                raise ValueError(f"the index does not lead to key {shard.keys[lost][0]}")
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.keys == NO_ID), pa.array(start + shard.offsets[records]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record of the files at path, found through the shards' indexes."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    starts = shard_starts(shards)
    if shards.count() <= 1 << 20:  # 16 MB; more shards are joined by a shuffle
        starts = F.broadcast(starts)
    return shards.select("shard", "body").join(starts, "shard").select("start", "body").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(shards: np.ndarray, first: np.ndarray, last: np.ndarray):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, key) for the shards whose range of keys holds the key; they lie side by side, as ranges ascend."""
        for batch in batches:
            keys = ids_of(batch.column("key"))
            low, high = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
            n = np.maximum(high - low, 0)
            yield pa.RecordBatch.from_arrays([pa.array(shards[spread(low, n)]), pa.array(np.repeat(keys, n))], ["shard", "key"])

    return dealt


def _records(shard_body: pa.Buffer, number: int, keys: np.ndarray) -> list[tuple]:
    """(key, shard, ids) of the keys that a shard holds, read in place."""
    shard = Shard(shard_body)
    found = zip(keys.tolist(), shard.find(keys).tolist(), strict=True)
    return [(key, number, shard.ids(record).astype(np.int64)) for key, record in found if record >= 0 and shard.keys[record] == key]


def _record_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "shard", "ids"])


def _lookup(table: pa.Table, wanted: pa.Table) -> pa.Table:
    keys = ids_of(wanted.column("key"))
    return _record_table([r for number, body in zip(table.column("shard").to_pylist(), table.column("body"), strict=True) for r in _records(body.as_buffer(), number, keys)])


def _lookup_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, body, keys in zip(batch.column("shard").to_pylist(), batch.column("body"), batch.column("keys").to_pylist(), strict=True):
            yield from _record_table(_records(body.as_buffer(), number, np.array(keys, np.int64))).to_batches()


def lookup_tokens(spark: SparkSession, path: str, wanted: DataFrame, most_ranges: int = 1 << 20, most_keys: int = 2_000_000, most_literals: int = 1000) -> DataFrame:
    """(doc_id, ids) of the keys in wanted (doc_id) that the files at path hold, by the shards' indexes; repeated keys give their first record.

    The shards' key ranges are sent to tasks up to ``most_ranges`` of them (24 MB) and joined
    beyond. Up to ``most_keys`` pairs of a key and a shard that may hold it are broadcast: then
    only files with such a shard are read, up to ``most_literals`` shards are named in the
    scan's own filter, and bodies are read where they are, not moved. More keys meet the shards by
    a shuffle of those that match. Null and unknown keys give no row, and neither does an empty
    table of keys.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    keys = wanted.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    ranges = shards.select("shard", "first_key", "last_key")
    if ranges.count() <= most_ranges:
        found = ranges.toArrow().sort_by("shard")
        dealt = cut(keys.mapInArrow(_dealt(*(found.column(c).to_numpy() for c in ("shard", "first_key", "last_key"))), "shard long, key long"))
    else:
        width = F.lit(1 << 20)  # ranges and keys meet in blocks of keys
        blocks = F.explode(F.sequence(F.floor(F.col("first_key") / width), F.floor(F.col("last_key") / width))).alias("block")
        met = keys.withColumn("block", F.floor(F.col("key") / width)).join(spark.read.schema(_SHARDS).parquet(path).select("shard", "first_key", "last_key", blocks), "block")
        dealt = cut(met.where("key between first_key and last_key").select("shard", "key").distinct())
    by_shard = dealt.groupBy("shard").agg(F.collect_list("key").alias("keys"))
    pairs = dealt.count()
    if not pairs:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    if pairs <= most_keys:
        matched = by_shard.select("shard")
        held = shards.select("shard", F.col("_metadata.file_path").alias("file")).join(F.broadcast(matched), "shard").select("file").distinct()
        some = spark.read.schema(_SHARDS).parquet(*(r["file"] for r in held.collect()))  # as many files as shards at most
        numbers = [r["shard"] for r in matched.limit(most_literals + 1).collect()]
        some = some.where(F.col("shard").isin(numbers)) if len(numbers) <= most_literals else some
        found = some.select("shard", "body").join(F.broadcast(by_shard), "shard").mapInArrow(_lookup_in_place, "doc_id long, shard long, ids array<long>")
    else:
        moved = shards.select("shard", "body").join(by_shard.select("shard"), "shard", "left_semi")
        found = moved.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_lookup, "doc_id long, shard long, ids array<long>")
    return found.groupBy("doc_id").agg(F.min_by("ids", "shard").alias("ids"))


def round_trip(docs: DataFrame, tokenizer: str, style: str, end_id: int) -> DataFrame:
    """Write docs' ids to a new folder below the shared one and read their positions, lengths and checksums back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, style, end_id)
    return read_token_files(spark, path)
