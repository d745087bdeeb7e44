import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.common import buffers
from corpusmill.llm.suffix_dedup import _sample, anchors, leading, segments, suffix_dedup
from tests.llm.helpers import ODD, frame, texts


def brute(rows):
    first, big = {}, 1 << 62
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], big), big - 1 if i is None else i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (big - 1 if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **sizes):
    return sorted((tuple(r) for r in suffix_dedup(df, **sizes).select("doc_id", "n_bytes", "n_removed", F.size("span_start"), F.sha2("kept", 256)).collect()), key=repr)


ROWS = [*enumerate(texts(1, 80)), *enumerate(ODD, 500), *enumerate(ODD, 600), (None, "a" * 80), (None, texts(1, 80)[0]), (7, texts(1, 80)[7]), (7, "another text of the same id " * 4)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "bucket_bytes": 2000, "sample_bytes": 20_000}, {"block_bytes": 3000, "bucket_bytes": 2000, "sample_bytes": 20_000, "most_ranges": 3}])
def test_like_brute_force(spark, sizes):
    assert found(frame(spark, ROWS), **sizes) == brute(ROWS)


def test_one_passage_in_most_documents(spark):
    passage = "this passage stands in nearly every one of the documents of this table and is long "
    rows = [(i, f"{i} own words {i * i} {passage if i % 4 else ''}{i}") for i in range(300)]
    assert found(frame(spark, rows), block_bytes=2000, bucket_bytes=1500, sample_bytes=50_000) == brute(rows)


def test_carried_columns_and_characters(spark):
    rows = [(1, "é" * 60 + "end"), (2, "x" + "é" * 60 + "ü")]
    got = suffix_dedup(frame(spark, rows), carry=("n_words", "kept"), characters=True)
    assert got.columns[-2:] == ["n_words", "kept"]
    assert {r[0]: bytes(r[5]).decode() for r in got.collect()} == {1: "é" * 60 + "end", 2: "xü"}


def test_empty(spark):
    assert suffix_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_each_hot_anchor_is_sampled():
    """Of ten strings that 400 documents hold each, every one gives about an eighth of its places to the sample."""
    rng = random.Random(8)
    strings = ["".join(rng.choice("abcdefgh") for _ in range(70)) for _ in range(10)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": [f"{i:08d}{strings[i % 10]}{i:08d}" for i in range(4000)]})
    data, offsets = buffers(batch.column("text"))
    starts, _, _ = segments(data, offsets)
    every = Counter(x[:16] for x in leading(data, starts + anchors(data, starts), np.zeros(len(starts), np.int64)).tolist())
    hot = {x for x, n in every.items() if n >= 400}
    [got] = _sample(8)([batch])
    keys = got.column("keys")[0].as_py()
    found = Counter(keys[a : a + 16] for a in range(0, len(keys), 24))
    assert len(hot) >= 10 and all(every[x] / 16 < found[x] < every[x] / 4 for x in hot)
