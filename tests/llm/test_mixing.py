"""Mixing: targets by another computation, taken words from the mixed blocks themselves."""

import collections

import numpy as np
import pytest

from corpusmill.llm.mixing import Mix, Permutation, mix_sources, mix_summary, shared_out
from tests.llm.helpers import ODD, texts, words_of


def targets(sizes, weights, wanted, most):
    """Excess by excess, as the rule is told."""
    out, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = wanted
    while open_ and rest > 1e-9:
        total, excess = sum(weights[s] for s in open_), 0.0
        for s in sorted(open_):
            out[s] += rest * weights[s] / total
        for s in sorted(open_):
            if out[s] >= most * sizes[s]:
                excess += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
        rest = excess
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 3, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, start string")


def check(spark, rows, mix):
    df = table(spark, rows)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    sizes = {n: sum(len(words_of(t)) for _, t, s in rows if s == n) for n in names}
    weights = {n: mix.weights[k % len(mix.weights)] for k, n in enumerate(names)}
    keyed = {n: str(k) for k, n in enumerate(names)}
    wanted = targets({keyed[n]: v for n, v in sizes.items()}, {keyed[n]: v for n, v in weights.items()}, mix.share * sum(sizes.values()), mix.most)
    summary = mix_summary(df, mix).collect()
    assert sorted((repr(r.doc_id), r.source or "", r.size) for r in summary) == sorted((repr(i), s or "", len(words_of(t))) for i, t, s in rows)
    by_source = collections.Counter()
    for r in summary:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[keyed[r.source]])
        assert 0 <= r.taken <= mix.most * r.size
        by_source[r.source] += r.taken
    for n in names:
        assert abs(by_source[n] - wanted[keyed[n]]) <= 0.5 + 1e-6
    assert sorted(summary, key=repr) == sorted(mix_summary(df.repartition(3), mix).collect(), key=repr)
    # the mixed blocks hold the documents' own words, and as many of each as the summary says
    mixed, taken = mix_sources(df, mix).collect(), collections.Counter()
    known = collections.defaultdict(set)
    for i, t, s in rows:
        known[i, s].add(tuple(words_of(t)))
    for r in mixed:
        assert r.n_words == len(r.words) and any(list(w[r.from_word : r.from_word + r.n_words]) == r.words for w in known[r.doc_id, r.source])
        taken[r.doc_id, r.source] += r.n_words
    own = collections.Counter()
    for r in summary:
        own[r.doc_id, r.source] += r.taken
    assert taken == +own
    slots = collections.defaultdict(list)
    for r in mixed:
        slots[r.shard, r.slot].append((r.part, r.n_words))
    for parts in slots.values():  # pieces of a slot follow one another, a block at most
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [p for p, _ in parts] == [0, *ends[:-1]] and ends[-1] <= mix.block
    shards = collections.Counter(shard for shard, _ in slots)
    assert all(n == mix.slots for shard, n in shards.items() if shard < max(shards)) and all(n <= mix.slots for n in shards.values())


@pytest.mark.parametrize("mix", [Mix(block=16, slots=20), Mix(block=7, slots=3, seed=5), Mix(block=4096), Mix(weights=(1.0,), share=0.3, most=1.0, block=10, slots=8)])
def test_sources_reach_their_targets(spark, mix):
    made = texts(3, 90)
    check(spark, [(i, t, ("a", "b", "a", "a", "", "\U00010000")[i % 6]) for i, t in enumerate(made)] + [(900, made[0], None)], mix)


def test_odd_rows(spark):
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, "a b c", "t"), (None, None, "t"), (3, "d e", "s"), (3, "f g h", "s"), (3, "f g h", "s")]
    check(spark, rows + [(50, "", "no words"), (51, "one two", "w")] + [(77, "same row again", "u")] * 40, Mix(block=4, slots=5))
    check(spark, [(1, None, "a"), (2, "", None)], Mix())


def test_empty_table(spark):
    assert mix_summary(table(spark, [])).count() == 0 and mix_sources(table(spark, [])).count() == 0


def test_permutations_are_whole_and_inverted():
    for n in (1, 2, 3, 17, 1000):
        full = lambda v, n=n: np.full(n, v)
        order = Permutation(4).at(np.arange(n), full(n), full(2), full(0))
        assert sorted(order) == list(range(n))
        assert (Permutation(4).place(order, full(n), full(2), full(0)) == np.arange(n)).all()
    other = Permutation(4).at(np.arange(1000), np.full(1000, 1000), np.full(1000, 2), np.ones(1000, int))
    assert (other != order).mean() > 0.9 and abs(np.corrcoef(order, np.arange(1000))[0, 1]) < 0.15


def test_excess_is_dealt_again():
    assert shared_out(np.array([10, 100, 1000]), np.array([5.0, 2, 1]), 600.0, 2).tolist() == [20, 200, 380]
    assert shared_out(np.array([0, 0]), np.array([5.0, 2]), 0.0, 2).tolist() == [0, 0]
