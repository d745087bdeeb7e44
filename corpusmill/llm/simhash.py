"""Near-duplicates by SimHash fingerprints, compared bit plane by bit plane.

Fingerprints within the radius agree in at least one of radius + 1 blocks of bits (or in
several of more blocks), so candidates share a key of whole blocks. Inside a key the
fingerprints lie as vertical bit planes: one 64-bit word holds one bit of 64 fingerprints. A
query's distances to all 64 grow together in carry-save counters, a word for each binary
digit, plane by plane, and a word is abandoned once every distance in it exceeds the radius.
Links leave a batch as a forest of the shortest ones, fewer than its fingerprints, never as all pairs.

For a given similarity of texts, ``similar_groups`` takes wider fingerprints, and candidates
share random samples of bits (blocks would need as many as the radius), and the texts of a
link are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import NO_ID, U64, buffers, cut, free_name, mixed, release_memory, spread
from corpusmill.llm.components import components, merged

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLAB = 1 << 14
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; the whole sequence if it has fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, seed), ">u8").astype(U64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]), ">u8").astype(U64)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: bit set if it is set in over half the hashes. Byte lanes count 255 hashes at a time."""
    counts = np.array([len(h) for h in hashes], np.int64)
    chunks = np.maximum(1, -(-counts // 255))
    padded = np.zeros(int(chunks.sum()) * 255, U64)
    first = np.concatenate(([0], np.cumsum(chunks)))[:-1]
    if counts.sum():
        padded[spread(first * 255, counts)] = np.concatenate(hashes)
    padded = padded.reshape(-1, 255)
    out = np.zeros(len(hashes), U64)
    for bit in range(8):
        lanes = ((padded >> U64(bit)) & U64(0x0101010101010101)).sum(axis=1, dtype=U64)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * ones[:, byte] > counts).astype(U64) << U64(8 * byte + bit)
    return out


def wide_fingerprints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of 64 bits a word, (words, texts), over each text's distinct hashes; each word has its own mix of them."""
    hashes = [np.unique(h) for h in hashes]
    return np.stack([fingerprints_of([mixed(h + U64(w * _STEP & (1 << 64) - 1)) for h in hashes]) for w in range(words)])


def names(words: int) -> list[str]:
    """Columns of a fingerprint with that many words."""
    return ["fp"] if words == 1 else [f"fp{w}" for w in range(words)]


def _fingerprints(size: int, seed: int, words: int):
    def of(held: list[np.ndarray]) -> np.ndarray:
        return fingerprints_of(held)[None] if words == 1 else wide_fingerprints(held, words)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            column = batch.column("text")
            data, offsets = buffers(column)
            found, held, total = [np.zeros((words, 0), U64)], [], 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.append(shingle_hashes(data[a:b].tobytes(), size, seed))
                total += len(held[-1])
                if total > 200_000:
                    found.append(of(held))
                    held, total = [], 0
            if held:
                found.append(of(held))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(w.view(np.int64)) for w in np.concatenate(found, axis=1))], ["doc_id", *names(words)])

    return fingerprint


def simhash(docs: DataFrame, size: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, fp long) of docs (doc_id, text), or fp0, fp1, ... for several words; texts without a word, and nulls, have fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(size, seed, words), ", ".join(f"{c} long" for c in ("doc_id", *names(words))))


def block_masks(n: int, radius: int, bucket: int = 64) -> list[int]:
    """Masks of which two fingerprints within the radius share at least one: as many bits as keep buckets small for n fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        if n >> (64 * (blocks - radius) // blocks) <= bucket:
            break
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(parts, blocks - radius)]


def similar_radius(similarity: float, words: int) -> int:
    """Bits in which 95 of 100 pairs of that Jaccard similarity differ at most, by the angle between their sets."""
    apart = _apart(similarity)
    return int(64 * words * apart + 1.645 * math.sqrt(64 * words * apart * (1 - apart)))


def _apart(similarity: float) -> float:
    """Share of bits in which equally large sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_masks(n: int, similarity: float, words: int, found: float = 0.98, bucket: int = 256) -> list[tuple[int, ...]]:
    """Masks (one for each word) of which pairs of that similarity share at least one with probability ``found``.

    The masks take as many bits as keep buckets small for n fingerprints, in turn from random
    orders of all bits; those from one order don't overlap. More fingerprints get more bits and
    more masks. Up to ``bucket`` fingerprints there is one empty mask: all are compared.
    """
    size = max(0, math.ceil(math.log2(max(n, 1) / bucket)))
    if not size:
        return [(0,) * words]
    count = math.ceil(math.log(1 - found) / math.log1p(-((1 - _apart(similarity)) ** size)))
    rng, masks = np.random.default_rng(size), []
    while len(masks) < count:
        order = rng.permutation(64 * words).tolist()
        for a in range(0, 64 * words - size + 1, size):
            mask = sum(1 << bit for bit in order[a : a + size])
            masks.append(tuple(mask >> 64 * w & (1 << 64) - 1 for w in range(words)))
    return masks[:count]


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group (sorted group numbers) at most radius bits apart, with their distances, in slabs; fps is (words, fingerprints).

    Counters begin so far below their end that a carry out of them means over the radius.
    """
    parts, n = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps.T).view(np.uint8).reshape(n, 8 * parts), axis=1, bitorder="little")
    words = -(-n // 64)
    lanes = np.zeros((64 * parts, words * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(U64).reshape(64 * parts, words)
    end = np.searchsorted(group, group, "right")
    me = np.arange(n)
    first, last = (me + 1) // 64, (end - 1) // 64
    count = np.where(end > me + 1, last - first + 1, 0)
    edges = np.concatenate(([0], np.cumsum(count)))
    width = max(1, radius.bit_length())
    begin = (1 << width) - 1 - radius
    for a in range(0, int(edges[-1]), _SLAB):
        item = np.arange(a, min(a + _SLAB, int(edges[-1])))
        query = np.searchsorted(edges, item, "right") - 1
        word = first[query] + item - edges[query]
        low, high = np.clip(query + 1 - 64 * word, 0, 64), np.clip(end[query] - 64 * word, 0, 64)
        full = np.full(len(item), ~U64(0))
        mask = np.where(high >= 64, full, (U64(1) << np.minimum(high, 63).astype(U64)) - U64(1)) & (full << np.minimum(low, 63).astype(U64))
        over = ~mask
        counters = [full.copy() if begin >> c & 1 else np.zeros(len(item), U64) for c in range(width)]
        for p in range(64 * parts):
            x = planes[p][word] ^ (U64(0) - ((fps[p // 64][query] >> U64(p % 64)) & U64(1)))
            for c in range(width):
                counters[c], x = counters[c] ^ x, counters[c] & x
            over |= x
            if p % 8 == 7:
                live = over != ~U64(0)
                if not live.all():
                    query, word, over, *counters = (v[live] for v in (query, word, over, *counters))
                if not len(query):
                    break
        if len(query):
            at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            apart = sum(((c[at] >> lane.astype(U64)) & U64(1)).astype(np.int64) << k for k, c in enumerate(counters)) - begin
            yield query[at], 64 * word[at] + lane, apart


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Numbers of the edges that make up a minimum spanning forest: each tree takes its shortest way out (ties: the first edge), until none has one."""
    order = np.argsort(apart, kind="stable")
    labels, chosen = np.arange(n), []
    while len(order):
        a, b = labels[i[order]], labels[j[order]]
        out = a != b
        order, a, b = order[out], a[out], b[out]
        if not len(order):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, a, np.arange(len(order)))
        np.minimum.at(best, b, np.arange(len(order)))
        take = np.unique(best[best < len(order)])
        chosen.append(order[take])
        labels = merged(labels, a[take], b[take])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of whole numbers as rows of an array, whole tiles at a time: rows come sorted by part, key and tile, and those of the last tile wait for the next batch."""
    release_memory()
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held = rows if held is None else np.concatenate((held, rows), axis=1)
        tail = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
        keep = int(tail[-1]) + 1 if len(tail) else 0
        yield held[:, :keep]
        held = held[:, keep:]
    if held is not None:
        yield held


def _tiles_of(rows: np.ndarray) -> np.ndarray:
    """Each column's tile, from 0."""
    return np.cumsum(np.concatenate(([False], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))


def _links(radius: int, words: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tiles(batches):
            yield from _edges(rows, radius)

    return links


def _crossing(radius: int):
    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, key, tile, node, label, fingerprint) that are within the radius of a row of their tile with another label."""
        for rows in _whole_tiles(batches):
            if not rows.shape[1]:
                continue
            tile, label = _tiles_of(rows), rows[4]
            several = np.zeros(int(tile[-1]) + 1, bool)
            several[tile[1:][(tile[1:] == tile[:-1]) & (label[1:] != label[:-1])]] = True
            rows = rows[:, several[tile]]
            if not rows.shape[1]:
                continue
            found = np.zeros(rows.shape[1], bool)
            for i, j, _ in close_pairs(np.ascontiguousarray(rows[5:]).view(U64), _tiles_of(rows), radius):
                apart = rows[4][i] != rows[4][j]
                found[i[apart]] = found[j[apart]] = True
            yield pa.RecordBatch.from_arrays([pa.array(r[found]) for r in rows], [c.split()[0] for c in _crossed(len(rows) - 5).split(", ")])

    return crossing


def _crossed(words: int) -> str:
    return ", ".join(f"{c} long" for c in ("part", "key", "tile", "node", "label", *names(words)))


def _edges(rows: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """The shortest links that connect the fingerprints of each group as all links within the radius do."""
    if not rows.shape[1]:
        return
    group = _tiles_of(rows)
    tree = np.zeros((3, 0), np.int64)
    for pairs in close_pairs(np.ascontiguousarray(rows[4:]).view(U64), group, radius):
        tree = np.concatenate((tree, np.stack(pairs)), axis=1)
        tree = tree[:, nearest_forest(rows.shape[1], *tree)]
    if tree.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(rows[3][tree[1]]), pa.array(rows[3][tree[0]])], ["a", "b"])


def _dealt(classes: DataFrame, fps: list[str], masks: list[tuple[int, ...]], tile: int) -> DataFrame:
    """The rows of classes for each mask, with part, key and tile, sorted by these.

    A key with over ``tile`` fingerprints is dealt out as pairs of chunks, so no task holds more
    than two chunks of it and every pair meets in a tile.
    """
    others = [c for c in classes.columns if c not in (*fps, "node")]

    def key(mask: tuple[int, ...]):
        parts = [F.col(c).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for c, m in zip(fps, mask, strict=True)]
        return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

    keyed = classes.select(F.posexplode(F.array(*map(key, masks))).alias("part", "key"), *fps, "node", *others).withColumn("part", F.col("part").cast("long"))
    dealt = in_tiles(keyed, ["part", "key"], F.xxhash64(*fps, "part"), tile).select("part", "key", "tile", "node", *others, *fps)
    return dealt.repartition("part", "key", "tile").sortWithinPartitions("part", "key", "tile", *fps)


def in_tiles(rows: DataFrame, by: list[str], draw: Column, most: int) -> DataFrame:
    """rows with tile: where a group of ``by`` has over ``most`` rows these are dealt to chunks by ``draw``, and each row goes to a tile for its chunk and every chunk."""
    large = rows.groupBy(*by).count().where(F.col("count") > most).withColumn("chunks", F.ceil(F.col("count") / most)).drop("count")
    mine = F.pmod(draw, F.col("chunks"))
    tiles = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j)))
    return rows.join(large, by, "left").select(*rows.columns, F.explode(tiles).alias("tile"))


def fingerprint_links(classes: DataFrame, radius: int = 4, tile: int = 4096, masks: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Edges (a, b) that connect the nodes of classes (fp, node), one row for each distinct fp, as their links within the radius do.

    Wide fingerprints (fp0, fp1, ...) need ``masks``, by which those to compare are found.
    """
    fps = [c for c in classes.columns if c != "node"]
    masks = masks or [(m,) for m in block_masks(classes.count(), radius)]
    return _dealt(classes, fps, masks, tile).mapInArrow(_links(radius, len(fps)), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text); component_id is the smallest doc_id reachable by links.

    Null and wordless texts have fingerprint zero and link like any other. Rows with equal ids
    or texts each keep their row. A null doc_id counts as larger than any: a component of
    nothing else has a null id. Texts of any length are read whole, a batch at a time; other
    columns are ignored, and an empty table gives an empty result.
    """
    return _grouped(simhash(docs, size, seed), lambda classes: components(fingerprint_links(classes, radius)))


def _shingle_sets(size: int, seed: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                some = batch.slice(part, 200)
                data, offsets = buffers(some.column("text"))
                raw = data.tobytes()
                found = [np.unique(shingle_hashes(raw[a:b], size, seed)).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.ListArray.from_arrays(ends, np.concatenate(found))], ["node", "shingles"])

    return sets


#: Ids that are broadcast to filter a table by (16 bytes each); more of them are joined by a shuffle.
MOST_IDS = 4_000_000


def _with_ids(rows: DataFrame, name: str, ids: DataFrame, how: str) -> DataFrame:
    """rows with (left_semi) or without (left_anti) the ids, one column of that name, written to the shared folder first so that their number is known."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, name, how)


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """(node, shingles) of the documents that are nodes (one column, distinct), written to the shared folder."""
    texts = _with_ids(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")), "node", nodes, "left_semi")
    return cut(texts.mapInArrow(_shingle_sets(size, seed), "node long, shingles array<long>"))


def similar_links(docs: DataFrame, links: DataFrame, similarity: float, size: int, seed: int) -> DataFrame:
    """The links (a, b) of documents whose sets of shingles have that Jaccard similarity or more, by the sets themselves; two without a word are alike."""
    sets = _sets_of(docs, links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size, seed)
    both = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common, total = F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total")
    return both.select("a", "b", common, total).where(F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def _compared(similarity: float, radius: int):
    def compared(table: pa.Table) -> pa.Table:
        """A forest of links between rows of a tile with different labels, by their sets."""
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        fps = np.stack([table.column(c).to_numpy() for c in table.column_names if c.startswith("fp")]).view(U64)
        shingles = table.column("shingles").combine_chunks()
        flat, ends = shingles.flatten().to_numpy(), np.concatenate(([0], np.cumsum(shingles.value_lengths().to_numpy())))
        sets = [np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sizes, labels, found = np.array([len(s) for s in sets]), np.unique(label, return_inverse=True)[1], []
        joined = np.arange(len(sets))
        for i in range(len(sets) - 1):
            apart = np.bitwise_count(fps[:, i : i + 1] ^ fps[:, i + 1 :]).sum(axis=0) <= radius
            least, most = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
            for j in (i + 1 + np.flatnonzero(apart & (labels[i] != labels[i + 1 :]) & (least >= similarity * most))).tolist():
                if joined[labels[i]] == joined[labels[j]]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    found.append((node[i], node[j]))
                    joined = merged(joined, np.array([labels[i]]), np.array([labels[j]]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compared


def crossing_links(docs: DataFrame, labelled: DataFrame, radius: int, masks: list[tuple[int, ...]], similarity: float, size: int, seed: int, tile: int = 4096, small: int = 256) -> DataFrame:
    """Links (a, b) of that similarity between nodes of labelled (fp0, ..., node, label) with different labels that are within the radius and share a mask.

    Only nodes that have such a partner take their sets of shingles along; the sets are
    compared in tiles of at most 2 * ``small`` nodes, which give a forest of the links they find.
    """
    fps = [c for c in labelled.columns if c not in ("node", "label")]
    rows = cut(_dealt(labelled.select("node", "label", *fps), fps, masks, tile).mapInArrow(_crossing(radius), _crossed(len(fps))))
    sets = _sets_of(docs, rows.select("node").distinct(), size, seed)
    dealt = in_tiles(rows.withColumnRenamed("tile", "outer"), ["part", "key", "outer"], F.xxhash64("node", "part"), small)
    return dealt.join(sets, "node").groupBy("part", "key", "outer", "tile").applyInArrow(_compared(similarity, radius), "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, seed: int = 42, words: int = 4) -> DataFrame:
    """(doc_id, fp0, ..., component_id) like ``simhash_groups``, for texts whose sets of word shingles have that Jaccard similarity or more.

    Candidates are fingerprints of ``words`` times 64 bits over distinct shingles, at most
    ``similar_radius`` bits apart, that share one of ``sampled_masks``: of pairs of just that
    similarity 95 of 100 lie within the radius and 98 of 100 of all share a mask; more similar
    ones are found more surely. The shortest candidates that connect those of a mask are checked
    by the sets themselves first, and join large groups with few checks; then all candidates
    between groups are. No pair below the similarity links, and no candidate of it is lost.

    Equal fingerprints always link. Rows without an id link with these only. Rows with equal
    ids link if one of them does. Null and wordless texts have fingerprint zero. Repeated rows
    keep their rows, other columns are ignored, an empty table gives an empty result. Very long
    texts are held whole, a few at a time.
    """

    def connected(classes: DataFrame) -> DataFrame:
        known = classes.where(F.col("node") != NO_ID)
        radius, masks = similar_radius(similarity, words), sampled_masks(known.count(), similarity, words)
        near = fingerprint_links(known, radius, masks=masks)
        checked = cut(similar_links(docs, cut(near.distinct()), similarity, size, seed))
        first = components(checked)
        labelled = known.join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        crossing = cut(crossing_links(docs, labelled, radius, masks, similarity, size, seed))
        if not crossing.head(1):
            return first
        stars = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return components(stars.union(crossing))

    return _grouped(simhash(docs, size, seed, words), connected)


def _grouped(rows: DataFrame, connected) -> DataFrame:
    fps = [c for c in rows.columns if c != "doc_id"]
    rows = cut(rows)
    classes = cut(rows.groupBy(*fps).agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("node")))
    labelled = classes.join(connected(classes), "node", "left").select(*fps, F.nullif(F.coalesce("component", "node"), F.lit(NO_ID)).alias("component_id"))
    return rows.join(labelled, fps).select("doc_id", *fps, "component_id")


def simhash_keep_first(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """docs without the rows whose group (``simhash_groups``) has a smaller doc_id, and one row for each doc_id, with all their columns.

    Rows without a doc_id stay, one for each text. Texts of any length stay as they are, and an
    empty table gives an empty one.
    """
    return _first(docs, simhash_groups(docs, radius, size, seed))


def similar_keep_first(docs: DataFrame, similarity: float = 0.8, size: int = 5, seed: int = 42, words: int = 4) -> DataFrame:
    """Like ``simhash_keep_first``, with the groups of ``similar_groups``."""
    return _first(docs, similar_groups(docs, similarity, size, seed, words))


def _first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the ids that aren't their component's; of the rows of an id, or of a text without an id, one stays."""
    name = free_name(docs, "simhash_id")
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("own"), F.count("*").alias("rows"))
    by_id = cut(by_id)
    known = docs.where("doc_id is not null").withColumn(name, F.col("doc_id").cast("long"))
    known = _with_ids(known, name, by_id.where("not own").select(F.col("doc_id").alias(name)), "left_anti")
    several = cut(by_id.where("own and rows > 1").select(F.col("doc_id").alias(name)))
    repeated = _with_ids(known, name, several, "left_semi").dropDuplicates([name])
    single = _with_ids(known, name, several, "left_anti")
    others = docs.where("doc_id is null").withColumn(name, F.sha2("text", 256)).dropDuplicates([name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).union(repeated.select(*columns)).union(others.select(*columns))
