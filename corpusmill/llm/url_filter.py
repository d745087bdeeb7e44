"""URL rules and an exact block list held as a cascade of Bloom filters, in DataFrame functions only.

A cascade knows the corpus's complete key universe. Level 1 is a Bloom filter of the listed
keys that occur in it; level 2 one of the other keys that level 1 lets through; level 3 one of
the listed keys that level 2 lets through, and so on until nothing is let through wrongly. The
first level that refuses a key decides it, so membership is exact for every key of the
universe, with no join against the list.

The first level's rate of false positives is set to leave about as many of them as there are
listed keys, so the cascade's size follows the list and the logarithm of the universe, not the
universe. A list whose cascade would be over ``max_bytes`` is dealt by a hash of the keys to as
many cascades as it takes, each of which judges its own part of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_BUCKET_BITS = 8 * 4096  # of bitmap_construct_agg


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: bytes


def _positions(key: Column, depth: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(f"{depth}:{i}")), F.lit(bits)) for i in range(hashes)]


def _passes(key: Column, depth: int, level: Level) -> Column:
    """Whether all of a key's bits are on. The plan names a level's bytes once, however many hashes it has."""
    byte = lambda at: F.conv(F.hex(F.substring(F.lit(level.words), (at / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    return F.forall(F.array(*_positions(key, depth, level.bits, level.hashes)), lambda at: F.getbit(byte(at), F.pmod(at, F.lit(8)).cast("int")) == 1)


def _level(keys: DataFrame, depth: int, n: int, rate: float) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -8 * (-math.ceil(1.4427 * hashes * n) // 8))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), depth, bits, hashes))).alias("at"))
    one_on = F.col("at") + 1  # the bitmap functions count positions and buckets from 1
    parts = at.groupBy(F.bitmap_bucket_number(one_on).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_on)).alias("map")).collect()
    words = bytearray(-(-bits // _BUCKET_BITS) * _BUCKET_BITS // 8)
    for bucket, bitmap in parts:
        start = (bucket - 1) * _BUCKET_BITS // 8
        words[start : start + len(bitmap)] = bitmap
    return Level(bits, hashes, bytes(words[: bits // 8]))


def planned_bytes(listed: int, others: int) -> int:
    """About what a cascade for so many keys takes."""
    return int(listed * (1.4427 * max(1.0, math.log2(1.5 * max(1, others) / max(1, listed))) + 6) / 8) + 4096


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The levels that tell the listed keys of universe (key) from the others. Both frames may repeat keys; nulls are left out."""
    keys = cut(universe.select("key").where("key is not null").distinct().join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    n, others = counts.get(True, 0), counts.get(False, 0)
    if not n:
        return []
    levels: list[Level] = []
    mine, rest = keys.where("listed"), keys.where("not listed")
    rate = min(0.5, n / (math.sqrt(2) * max(1, others)))
    while n:
        levels.append(_level(mine, len(levels), n, rate if n > 1000 else min(rate, 1 / 4096)))  # small levels end the cascade early
        mine, rest, rate = rest.where(_passes(F.col("key"), len(levels) - 1, levels[-1])), mine, 0.5
        n = mine.count()
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed; null and keys of an empty list are not."""
    if not levels:
        return F.lit(False)
    found = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        found = F.when(_passes(key, depth, levels[depth]), found).otherwise(F.lit(depth % 2 == 1))
    return F.coalesce(found & key.isNotNull(), F.lit(False))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """A host's last three labels, or all of it if it has fewer; null for an empty host."""
    return F.nullif(F.substring_index(host, ".", -3), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, max_bytes: int = 32 << 20) -> DataFrame:
    """pages (page_id, url, ...) with host, path, rule and verdict.

    The longest rule that fits a url decides; where none fits, sites of listed (key) are
    blocked and all others allowed. A null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed. Urls of any length are read whole. Rows are kept as they
    are, repeats included; of the other columns only page_id is returned. Rules of equal length
    that both fit are the same rule. An empty table gives an empty result, and an empty list
    blocks nothing.
    """
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    site = site_of(F.col("host"))
    universe = rows.select(site.alias("key")).distinct()
    parts = -(-planned_bytes(listed.count(), universe.count()) // max(max_bytes, 8192))

    def judged(part: int) -> DataFrame:
        mine = lambda key: F.coalesce(F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)), F.lit(0)) == part if parts > 1 else F.lit(True)
        levels = build_cascade(universe.where(mine(F.col("key"))), listed.where(mine(F.col("key"))))
        return rows.where(mine(site)).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(in_cascade(site, levels), "block").otherwise("allow")).alias("verdict"))

    return reduce(DataFrame.union, map(judged, range(parts)))
