import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import intervals, metrics, rows


@pytest.mark.parametrize("width", [None, 1, 3, 9, 100])
def test_tiles_of_masks(spark, width):
    """Tiles of 4 x 4 against the masks themselves."""
    rng, blocks = random.Random(2), [[], [-1] * 6, [0] * 21, [0, 1, 2, 3]]
    for _ in range(20):
        ids = [s for s in range(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 12))]
        blocks.append(ids + [-1] * rng.randrange(4))
    df = spark.createDataFrame(list(enumerate(blocks)), "window long, seq_ids array<int>")
    got = {(r.window, r.q_tile, r.k_tile): r.whole for r in intervals.mask_tiles(df, "window", F.col("seq_ids"), 4, width).collect()}
    wanted = {}
    for w, ids in enumerate(blocks):
        n = -(-len(ids) // 4) * 4
        mask = np.zeros((n, n), bool)
        for i, a in enumerate(ids):
            for j, b in enumerate(ids[: i + 1]):
                mask[i, j] = a == b >= 0 and (width is None or i - j < width)
        tiles = mask.reshape(n // 4, 4, n // 4, 4).transpose(0, 2, 1, 3)
        wanted |= {(w, int(q), int(k)): bool(tiles[q, k].all()) for q, k in np.argwhere(tiles.any(axis=(2, 3)))}
    assert got == wanted


def test_triples_lie_in_their_spans(spark):
    spans = spark.createDataFrame([(w, b, b + n) for w in range(30) for b, n in ((0, 2), (5, 3), (10, 40))], "window long, begin long, end long")
    for width in (None, 2, 5):
        got = metrics.tube_triples(spans, ("window",), 8, width, seed=1).collect()
        assert all(r.begin <= r.s < r.r < r.t < r.end and (width is None or r.t - r.s <= width) for r in got)
        assert {r.begin for r in got} == {5, 10} and len({(r.s, r.r, r.t) for r in got if r.begin == 10}) > 30
        assert got and (width is not None or len(got) == 30 * 2 * 8)
    with pytest.raises(ValueError, match="max_width"):
        metrics.tube_triples(spans, ("window",), 1, 1)


def test_tube_losses(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((20, 5))
    hidden = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors)], "window long, place long, vector array<double>")
    triples = spark.createDataFrame([(0, 0, 20, d, d, d + 2, d + 7) for d in range(12)] + [(1, 0, 20, 0, 1, 2, 3)], "window long, begin long, end long, draw int, s long, r long, t long")
    found = metrics.tube_losses(hidden, triples, ("window",))
    got = {r.draw: r.loss for r in found.collect()}
    for d, loss in got.items():
        f, p = vectors[d + 7] - vectors[d + 2], vectors[d + 2] - vectors[d]
        assert math.isclose(loss, 1 - f @ p / np.linalg.norm(f) / np.linalg.norm(p), rel_tol=1e-9)
    assert len(got) == 12 and math.isclose(metrics.mean_tube_loss(found).first()[0], sum(got.values()) / 12)
    assert tuple(metrics.mean_tube_loss(found.limit(0)).first()) == (0.0, 0)


@pytest.mark.parametrize(("n", "k"), [(1, 3), (2, 3), (30, 5), (300, 4)])
def test_few_shot_members(spark, n, k):
    items = spark.createDataFrame([(3 * i,) for i in range(n)], "item_id long").repartition(3)
    got = {(r.item_id, r["rank"]): r.shot for r in rows.few_shot(items, k).collect()}
    wanted = {}
    for i in range(n):
        picked = random.Random(1234 + i).sample([x for x in range(n) if x != i], min(k, n - 1))
        wanted |= {(3 * i, rank): 3 * x for rank, x in enumerate(picked, 1)}
    assert got == wanted
