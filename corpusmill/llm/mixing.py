"""Mixing sources to target weights, by fixed-length blocks of words and drawn block indexes.

Each source's documents, end to end in the order of their ids, are cut into blocks of equal
length. Output shards draw how many of their slots each source gets from a multinomial. The
slots of a source are numbered over all shards, and slot k takes the block at place k of the
source's pseudorandom permutations: one permutation after the other, so that no block is taken
a second time before all were taken once. Slots and blocks meet in a join by index; the key
holds the block's number, so a source with a third of all words is many keys. What goes
through the driver is one row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, mixed, shared_path
from corpusmill.operators.intervals import with_offsets

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights (repeating over the sources in order), the words wanted as a share of all, and how often a source is used at most.

    ``block`` is the words of a block and ``slots`` the blocks of an output shard.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    block: int = 256
    slots: int = 1024
    seed: int = 1


def shared_out(sizes: np.ndarray, weights: np.ndarray, wanted: float, most: float) -> np.ndarray:
    """wanted dealt by weight, no more than most * size to a source, the excess to the others by weight until none is above."""
    limits, full = most * sizes.astype(float), np.zeros(len(sizes), bool)
    while True:
        rest = weights[~full].sum()
        level = max(0.0, wanted - limits[full].sum()) / rest if rest else 0.0
        targets = np.where(full, limits, level * weights)
        above = ~full & (targets > limits)
        if not above.any():
            return targets
        full |= above


class Permutation:
    """A pseudorandom permutation of 0 .. n - 1 for each (source, turn): a Feistel network on the next even number of bits, walked until it is below n."""

    def __init__(self, seed: int, rounds: int = 6):
        self.seed, self.rounds = U64(seed), rounds

    def _round(self, half: np.ndarray, k: int, key: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return mixed(half + key + U64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask

    def _pass(self, x: np.ndarray, n: np.ndarray, source: np.ndarray, turn: np.ndarray, back: bool) -> np.ndarray:
        bits = np.array([max(1, (int(v) - 1).bit_length() + 1 >> 1) for v in np.unique(n)], U64)[np.unique(n, return_inverse=True)[1]]
        mask = (U64(1) << bits) - U64(1)
        key = mixed(mixed(self.seed + mixed(source.astype(U64) + U64(1))) + turn.astype(U64))
        x, todo = x.astype(U64), np.ones(len(x), bool)
        while todo.any():
            b, m, k = bits[todo], mask[todo], key[todo]
            high, low = x[todo] >> b, x[todo] & m
            for r in reversed(range(self.rounds)) if back else range(self.rounds):
                if back:
                    high, low = low ^ self._round(high, r, k, m), high
                else:
                    high, low = low, high ^ self._round(low, r, k, m)
            x[todo] = high << b | low
            todo = x >= n.astype(U64)
        return x.astype(np.int64)

    def at(self, place: np.ndarray, n: np.ndarray, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The block at each place."""
        return self._pass(place, n, source, turn, False)

    def place(self, block: np.ndarray, n: np.ndarray, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The place of each block: the inverse of ``at``."""
        return self._pass(block, n, source, turn, True)


@dataclass(frozen=True)
class Recipe:
    """The sources in order: names, words, targets, blocks, slots, and the words that a source's last slot is cut to (0: not cut)."""

    names: list
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last: np.ndarray


def recipe(names: list, sizes: list[int], mix: Mix) -> Recipe:
    """How often each source's blocks are taken, so that its words come to its target, rounded; its last slot is cut to fit."""
    size = np.array(sizes, np.int64)
    targets = shared_out(size, np.resize(np.array(mix.weights, float), len(size)), mix.share * float(size.sum()), mix.most)
    words = np.floor(targets + 0.5).astype(np.int64)
    blocks = -(-size // mix.block)
    tail = size - (blocks - 1) * mix.block  # the words of a source's last block
    used, b = size > 0, np.maximum(blocks, 1)
    turns = np.where(used, words // np.maximum(size, 1), 0)
    rest = np.where(used, words - turns * size, 0)
    short = Permutation(mix.seed).place(b - 1, b, np.arange(len(size)), turns)  # where the last turn has the short block
    before = -(-rest // mix.block)  # slots of the last turn, if all blocks were full
    more = np.where(before > short, -(-np.maximum(rest - tail, 0) // mix.block) + 1, before)
    slots = turns * blocks + more
    taken = (more - 1) * mix.block - np.where(more - 1 > short, mix.block - tail, 0)  # by the slots before the last
    return Recipe(names, size, targets, blocks, slots, np.where(more > 0, rest - taken, 0))


def _drawn(own: Recipe, mix: Mix):
    """(shard, source, count): each shard's multinomial draw."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = int(own.slots.sum())
        odds = own.slots / max(total, 1)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts = np.random.default_rng([mix.seed, shard]).multinomial(min(mix.slots, total - shard * mix.slots), odds)
                has = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(np.full(len(has), shard)), pa.array(has), pa.array(counts[has].astype(np.int64))], names=["shard", "source", "count"])

    return drawn


def _slots(own: Recipe, mix: Mix, totals: np.ndarray):
    """The blocks of each shard's slots.

    Draws leave a source some slots over or short of its own; those over, numbered by source,
    go to the sources that are short, in order, so all sources end at their own number.
    """
    over, short = np.maximum(totals - own.slots, 0), np.maximum(own.slots - totals, 0)
    over_before, short_ends = np.cumsum(over) - over, np.cumsum(short)
    order = Permutation(mix.seed)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, first, count = (batch.column(c).to_numpy() for c in ("shard", "source", "first", "count"))
            row = np.repeat(np.arange(len(count)), count)
            k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            s, shard = source[row].copy(), shard[row]
            moved = np.flatnonzero(k >= own.slots[s])
            g = over_before[s[moved]] + k[moved] - own.slots[s[moved]]
            to = np.searchsorted(short_ends, g, "right")
            s[moved], k[moved] = to, totals[to] + g - (short_ends - short)[to]
            n = own.blocks[s]
            turn = k // n
            block = order.at(k % n, n, s, turn)
            words = np.where(block == n - 1, own.sizes[s] - (n - 1) * mix.block, mix.block)
            words = np.where((k == own.slots[s] - 1) & (own.last[s] > 0), own.last[s], words)
            draw = mixed(k.astype(U64) + mixed(s.astype(U64) + mixed(U64([mix.seed])))).astype(np.int64)
            yield pa.record_batch([pa.array(x) for x in (shard, s, turn, block, words, draw)], names=["shard", "source_at", "turn", "block", "take", "draw"])

    return slots


def _rows(docs: DataFrame, source: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), text.alias("text"))
    return rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("tie", F.sha2("text", 256))


@dataclass(frozen=True)
class Places:
    """Documents laid end to end in their sources (doc_id, source, source_at, tie, size, start), without texts, and the recipe for the sources."""

    documents: DataFrame
    recipe: Recipe


def place_documents(docs: DataFrame, mix: Mix, source: str = "source") -> Places:
    """Where each document's words lie in its source.

    Documents follow one another in an order drawn by hash. Equal rows are placed as one and
    then dealt out, so no number of copies makes a large group. Places are written to the shared
    folder once: a task that runs again sees the same ones. (source_at, start) names a row with
    words.
    """
    spark = docs.sparkSession
    sized = _rows(docs, source).select("doc_id", "source", "tie", F.size("words").cast("long").alias("size"))
    path = shared_path(spark, "mix-sizes")
    sized.groupBy("doc_id", "source", "tie", "size").agg(F.count("*").alias("copies")).write.parquet(path)
    distinct = spark.read.parquet(path)
    # a row for each source
    found = distinct.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    own = recipe([r["source"] for r in found], [r["size"] for r in found], mix)
    numbers = spark.createDataFrame([(r["source"], k) for k, r in enumerate(found)], "name string, source_at long")
    keyed = distinct.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    keyed = keyed.withColumn("key", F.xxhash64(F.lit(mix.seed), "doc_id", "tie"))
    placed = with_offsets(keyed, F.col("size") * F.col("copies"), "key", ("source_at",), "first", bucket=1 << 53)
    every = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    path = shared_path(spark, "mix-places")
    every.select("doc_id", "source", "source_at", "tie", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start")).write.parquet(path)
    return Places(spark.read.parquet(path), own)


def draw_slots(spark: SparkSession, own: Recipe, mix: Mix) -> DataFrame:
    """(shard, source_at, turn, block, take, draw): the block of every slot, how many of its words it takes, and a number that orders a shard's slots."""
    shards = -(-int(own.slots.sum()) // mix.slots)
    counts = spark.range(shards).mapInArrow(_drawn(own, mix), "shard long, source long, count long")
    totals = np.zeros(len(own.slots), np.int64)
    for r in counts.groupBy("source").agg(F.sum("count").alias("n")).collect():  # a row for each source
        totals[r["source"]] = r["n"]
    numbered = with_offsets(counts, F.col("count"), "shard", ("source",), "first")
    return numbered.select("shard", "source", "first", "count").mapInArrow(_slots(own, mix, totals), "shard long, source_at long, turn long, block long, take long, draw long")


def mix_places(spark: SparkSession, places: Places, mix: Mix) -> DataFrame:
    """The mix without texts: shard, slot, part, source, turn, block, doc_id, tie, start (the document's), from_word and n_words, a row for each piece of a document in a slot."""
    size, block = F.col("size"), mix.block
    dealt = places.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + size - 1) / block))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    pieces = dealt.select("source", "source_at", "block", "doc_id", "tie", "start", (begin - F.col("start")).alias("from_word"), (begin - F.col("block") * block).alias("part"), (F.least(F.col("start") + size, (F.col("block") + 1) * block) - begin).alias("n"))
    slots = draw_slots(spark, places.recipe, mix)
    ranked = slots.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("draw", "source_at", "turn", "block")) - 1)
    joined = ranked.join(pieces.hint("merge"), ["source_at", "block"]).where(F.col("part") < F.col("take"))
    words = F.least(F.col("n"), F.col("take") - F.col("part"))
    return joined.select("shard", "slot", "part", "source", "source_at", "turn", "block", "doc_id", "tie", "start", "from_word", words.alias("n_words"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """The mix: shard, slot, part (order of a slot's pieces), source, doc_id, from_word, n_words and words.

    Sources, by code point with null last, get the weights in turn; together they share
    ``share`` times all words, none over ``most`` times its own (the excess goes to the others
    by weight). A source's taken words are its target, rounded. Null and empty texts have no
    words; null and repeated ids and equal rows are documents like any other; other columns are
    ignored, whatever their names; a source without words gets none, an empty table gives an
    empty mix. The same table and ``mix`` give the same rows.
    """
    places = place_documents(docs, mix, source)
    texts = _rows(docs, source).groupBy("doc_id", "tie").agg(F.first("words").alias("all"))
    found = mix_places(docs.sparkSession, places, mix).alias("m").join(texts.alias("t"), F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.tie") == F.col("t.tie")))
    words = F.slice("all", (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return found.select("shard", "slot", "part", "source", "m.doc_id", "from_word", "n_words", words.alias("words"))


def mix_summary(docs: DataFrame, mix: Mix = Mix(), source: str = "source") -> DataFrame:
    """For each row of docs what the mix takes of it: doc_id, source, size, source_size, target (its source's) and taken, in words."""
    spark = docs.sparkSession
    places = place_documents(docs, mix, source)
    own = places.recipe
    taken = mix_places(spark, places, mix).groupBy("source_at", "start").agg(F.sum("n_words").alias("n"))
    recipes = spark.createDataFrame([(k, int(own.sizes[k]), float(own.targets[k])) for k in range(len(own.names))], "source_at long, source_size long, target double")
    rows = places.documents.join(F.broadcast(recipes), "source_at")
    sized = rows.where("size > 0").join(taken.hint("merge"), ["source_at", "start"], "left").withColumn("taken", F.coalesce("n", F.lit(0)))
    columns = ("doc_id", "source", "size", "source_size", "target")
    return sized.select(*columns, "taken").union(rows.where("size = 0").select(*columns, F.lit(0).cast("long")))
