"""The pipeline against plain versions of its stages, on a small table, and the registered queries."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import common, queries, secrets, simhash
from tests.compare import same
from tests.llm.helpers import frame, texts, words_of
from tests.llm.test_quality_urls_secrets import LIMITS, PATTERNS, measured
from tests.llm.test_simhash import jaccard, wide_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])


def test_registered():
    assert [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert "pipeline" in __spark_entry__.queries()


def plain(rows):
    kept = {}
    for i, t in sorted(rows):
        m = measured(t)
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0] and 100 * m[5] <= LIMITS.covered_percent * m[0] and m[6] <= LIMITS.longest:
            kept[i] = t
    above = {i: i for i in kept}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    fps = {i: wide_fingerprint(t) for i, t in kept.items()}
    radius = simhash.similar_radius(0.8, 4)
    for a in kept:
        for b in kept:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and jaccard(kept[a], kept[b]) >= 0.8:
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if top(i) == i}
    seen, out = set(), {}
    for i, t in sorted(kept.items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= {raw[k : k + 50] for k in range(len(raw) - 49)}
        at, text = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text.append(c)
            at += n
        text = "".join(text)
        if not any(gone) or words_of(text):
            out[i] = text
    return out


def test_stages_like_plain_ones(spark):
    rows = [*enumerate(texts(11, 60, 200)), (100, "my password = abcdef123456 " + " ".join(f"w{i}" for i in range(20))), (101, None), (102, "too short")]
    docs = frame(spark, rows).selectExpr("*", "doc_id AS n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    assert {r.doc_id: r.text for r in docs.collect()} == plain([(i, t) for i, t in rows if t])
    docs = corpus_pipeline.secret_scans(spark, docs, SF)
    got = {r.doc_id: r for r in docs.collect()}
    assert got[100].text.startswith(f"my {secrets.MARK} w0") and got[100].n_chars == len(got[100].text)
    assert not any(p.search(r.text) and len(p.search(r.text)[0]) > 30 for r in got.values() for _, p, _ in PATTERNS[1:])
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(got)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _base string, spans array<int>, `a.b` int, _columns string, _carried_0 int, block string, kept binary"


def odd_rows():
    long = " ".join(f"word{i}" for i in range(150_000))
    texts_ = [(None, "no id " + " ".join(f"n{i}" for i in range(30))), (1, None), (2, ""), (3, " \n "), (4, long), (5, "é😀 " + " ".join(f"u{i}é" for i in range(40)))]
    texts_ += [(6, "same text " + " ".join(f"s{i}" for i in range(30)))] * 2 + [(7, "same text " + " ".join(f"s{i}" for i in range(30)))]
    return [(i, t, None, "k", len(t or ""), "b", [1], 2, "c", 3, "x", b"y") for i, t in texts_]


def test_run_over_odd_rows_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, tmp_path)
        assert docs.columns == [f.name for f in spark.createDataFrame([], SCHEMA).schema], name
    assert sorted((r.doc_id or 0, r["a.b"], r["_base"], r["spans"], r["_columns"]) for r in docs.collect()) == [(i, 2, "b", [1], "c") for i in (0, 4, 5, 6)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 4, 5, 6}
    long = sorted((r.start, r.length) for r in got if r.doc_id == 4)
    assert len(long) > 100 and all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False))


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_removes_folders_of_stages(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    common.clean_up(spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in common._WRITTEN] == ["pieces"]
    assert found.count() > 0
    common.clean_up(spark)
    assert not common._WRITTEN


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
