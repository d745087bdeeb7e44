import itertools
import random

import numpy as np
import pytest
import sentencepiece

from corpusmill.llm import pieces
from corpusmill.llm.pieces import Pieces, decode_pieces, encode_pieces, marked, resolve
from tests.llm.helpers import ODD, frame, texts, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "b", "th", "e", ".", "é", "́", "中", "1", "\r\n", "word", "▁", "😀", "\0", "    ", "ing", " the", "<s>", "　", "ﬁ", "\xa0"]


@pytest.fixture(scope="module")
def model():
    return Pieces(MODEL, limit=400)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(2)
    return texts(3, 20, 40) + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["a" * 300, "thethethethe" * 20, " " * 70] + [t or "" for t in ODD if len(t or "") < 1000]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_like_the_library(model, some):
    for text in some:
        found = model.encode([text])[0]
        assert ids(found) == model.model.encode(text)
        assert model.decode(found) == model.model.decode(ids(found))


@pytest.mark.parametrize("size", [9, 33, 100])
def test_chunks_like_the_library(model, some, size):
    for text in filter(None, some):
        s = marked(text)
        cuts = [(a, min(a + size, len(s))) for a in range(0, len(s), size)]
        parts = [(max(0, a - 64), s[max(0, a - 64) : b + 64]) for a, b in cuts]
        shift = lambda states, by: [(i + by, j + by) for i, j in states]
        moves = [model.transfer(part, a - base, b - base) for (a, b), (base, part) in zip(cuts, parts, strict=True)]
        moves = [(shift(x, base), shift(y, base), m) for (x, y, m), (base, _) in zip(moves, parts, strict=True)]
        found = b""
        for (a, b), (base, part), states in zip(cuts, parts, resolve(moves, len(s)), strict=True):
            found += model.between(part, *shift(states, -base), a - base, b - base)
        assert ids(found) == model.model.encode(text)


@pytest.mark.parametrize("size", [1 << 16, 300])
def test_rows(spark, model, size):
    rows = [*enumerate(texts(4, 25)), *enumerate(ODD, 100), (3, "again"), (None, "no id")]
    got = decode_pieces(encode_pieces(frame(spark, rows), MODEL, size), MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert sorted(r.n_tokens for r in got) == sorted(len(model.model.encode(t or "")) for _, t in rows)
    assert encode_pieces(frame(spark, rows).limit(0), MODEL).count() == 0


def test_pairs_of_matrices_like_a_fold():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 65):
        sizes = rng.integers(1, 6, n + 1)
        matrices = [np.where(rng.random((a, b)) < 0.5, 0.0, rng.choice([-1.0, -2.5, pieces.NO_WAY], (a, b))) for a, b in itertools.pairwise(sizes)]
        fold = [matrices[0]]
        for m in matrices[1:]:
            fold.append(pieces.product(fold[-1], m))
        assert all(np.array_equal(a, b) for a, b in zip(pieces.scan(matrices), fold, strict=True))
        assert np.array_equal(pieces.total(matrices), fold[-1])


@pytest.mark.parametrize("group", [1, 2, 64])
def test_giant_texts_in_groups_of_chunks(spark, group):
    rows = [(1, " ".join(texts(9, 90))), (2, "x" * 3000), (None, " ".join(texts(10, 60))), (2, "short"), (3, None), (4, "é😀\n  " * 600)]
    got = pieces.encode_pieces(frame(spark, rows), MODEL, chunk_chars=700, group=group).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((repr(i), model.encode(t or "")) for i, t in rows)
    assert pieces.encode_pieces(frame(spark, rows).limit(0), MODEL).count() == 0
