import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import simhash
from corpusmill.llm.components import components
from tests.llm.helpers import ODD, frame, texts, words_of


def fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def mix(x):
    m = 0xD6E8FEB86659FD93
    for k in (m, m, 1):
        x = (x ^ x >> 32) * k & (1 << 64) - 1
    return x


def shingles_of(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def wide_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles_of(text)]
    mixed = [[mix(h + w * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for h in hashes] for w in range(4)]
    return sum(1 << 64 * w + b for w in range(4) for b in range(64) if 2 * sum(h >> b & 1 for h in mixed[w]) > len(hashes))


def groups(ids, linked):
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in linked:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_like_brute_force(spark):
    rows = [*enumerate(texts(2, 120)), *enumerate(ODD, 500)]
    fps = {i: fingerprint(t) for i, t in rows}
    wanted = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert got == {i: (fps[i], wanted[i]) for i in fps}


@pytest.mark.parametrize("tile", [4096, 5])
@pytest.mark.parametrize("n", [0, 1 << 30])
def test_links_of_close_fingerprints(spark, tile, n, monkeypatch):
    monkeypatch.setattr(simhash, "block_masks", lambda count, radius, f=simhash.block_masks: f(n or count, radius))
    rng, fps = random.Random(4), set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(10):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    wanted = groups(range(len(fps)), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r.node: r.component for r in components(simhash.fingerprint_links(classes, 4, tile)).collect()}
    assert {i: got.get(i, i) for i in wanted} == wanted


def jaccard(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) / len(x | y) if x | y else 1


def test_similar_like_brute_force(spark):
    rows = [*enumerate(texts(6, 120)), *enumerate(ODD, 500)]
    fps, text, radius = {i: wide_fingerprint(t) for i, t in rows}, dict(rows), simhash.similar_radius(0.8, 4)
    wanted = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= radius and jaccard(text[a], text[b]) >= 0.8])
    got = {r.doc_id: (sum((r[f"fp{w}"] & (1 << 64) - 1) << 64 * w for w in range(4)), r.component_id) for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == {i: (fps[i], wanted[i]) for i in fps}
    assert len(set(wanted.values())) < len(wanted) - 20


def test_nearest_forest():
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(9)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    found = simhash.nearest_forest(50, *(np.array(x) for x in zip(*edges, strict=True)))
    above, total, count = {i: i for i in range(50)}, 0, 0

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if top(a) != top(b):
            above[top(a)], total, count = top(b), total + w, count + 1
    assert (len(found), sum(edges[k][2] for k in found)) == (count, total)
    assert len(simhash.nearest_forest(3, *np.zeros((3, 0), np.int64))) == 0


def edited(rng, words, similarity):
    """words with some of them changed, at least that similar by their sets of five-word strings."""
    out, before = list(words), set(zip(*(words[i:] for i in range(5)), strict=False))
    while True:
        was, at = list(out), rng.randrange(len(words))
        out[at] += "x"
        now = set(zip(*(out[i:] for i in range(5)), strict=False))
        if len(now & before) < similarity * len(now | before):
            return was


@pytest.mark.parametrize("n", [1 << 13, 1 << 18, 1 << 24])
def test_similar_texts_are_found(spark, n, monkeypatch):
    """Of texts at or just over the similarity, nearly all link; texts below it don't."""
    monkeypatch.setattr(simhash, "sampled_masks", lambda count, similarity, words, f=simhash.sampled_masks: f(n, similarity, words))
    rng, rows = random.Random(8), []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(edited(rng, words, 0.8))), (3 * k + 2, " ".join(words[:250] + [f"v{rng.randrange(5000)}" for _ in range(50)]))]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert sum(got[3 * k + 1] == 3 * k for k in range(150)) >= 130
    assert all(got[3 * k + 2] == 3 * k + 2 for k in range(150))


def test_similar_keep_first(spark):
    rows = [(5, "one two three four five six"), (3, "ONE two three four five six"), (3, "one two three four five six"), (9, "something else"), (None, "alone here"), (8, None), (7, "")]
    kept = simhash.similar_keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_words", "block", "kept"]
    got = sorted(r.doc_id or -1 for r in kept.collect())
    assert got == [-1, 3, 7, 9]
    assert simhash.similar_keep_first(frame(spark, rows).limit(0)).count() == 0


def test_masks():
    assert simhash.sampled_masks(256, 0.8, 4) == [(0, 0, 0, 0)]
    few, many = simhash.sampled_masks(1 << 18, 0.8, 4), simhash.sampled_masks(1 << 28, 0.8, 4)
    assert {sum(m.bit_count() for m in x) for x in few} == {10} and {sum(m.bit_count() for m in x) for x in many} == {20}
    assert len(set(many)) == len(many) > len(few)
    assert sum(m.bit_count() for m in (np.bitwise_or.reduce([np.uint64(x[w]) for x in few]).item() for w in range(4))) == 10 * len(few)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    wanted = groups({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in wanted.items())


def test_keep_first(spark):
    rows = [(5, "one two three four five"), (3, "one two three four five"), (3, "one two three four five"), (9, "something else"), (None, "alone here"), (None, "one two three four five")]
    kept = simhash.simhash_keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_words", "block", "kept"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "alone here"), (-1, "one two three four five"), (3, "one two three four five"), (9, "something else")]


def test_empty(spark):
    assert simhash.simhash_groups(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_bit_counts():
    rng = np.random.default_rng(1)
    hashes = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 254, 255, 256, 1000)]
    wanted = [sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) for h in hashes]
    assert simhash.fingerprints_of(hashes).tolist() == wanted


@pytest.mark.parametrize("most", [256, 3])
def test_no_candidate_is_lost_where_fingerprints_and_sets_rank_differently(spark, most):
    """Chains of texts around the similarity: the shortest candidate of many a text is no link by the sets, and a longer one is."""
    rng, rows, doc = random.Random(12), [], 0
    for _ in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(8):
            rows.append((doc, " ".join(words)))
            doc += 1
            for _ in range(rng.choice([1, 1, 2])):
                words[rng.randrange(60)] += "y"
    fps, radius = {i: wide_fingerprint(t) for i, t in rows}, simhash.similar_radius(0.8, 4)
    texts_of = dict(rows)
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius]
    links = [(a, b) for a, b in near if jaccard(texts_of[a], texts_of[b]) >= 0.8]
    wanted = groups(set(fps), links)
    docs = frame(spark, rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == wanted and len(near) > len(links) + 50
    # between groups alone, in small tiles: every node its own label
    classes = simhash.simhash(docs, 5, 42, 4).withColumnRenamed("doc_id", "node").withColumn("label", F.col("node"))
    found = simhash.crossing_links(docs, classes, radius, [(0, 0, 0, 0)], 0.8, 5, 42, tile=64, small=most)
    assert groups(set(fps), [tuple(r) for r in found.collect()]) == wanted
