"""Objects of JSON arrays by splits of a few bytes against Python's decoder."""

import json
import random

import pytest

from corpusmill.operators.intervals import chunk_records
from corpusmill.sources import readers
from corpusmill.sources.json_arrays import array_objects


def plain(text):
    """The objects, and whether the array is whole, as a decoder that reads on gives them."""
    decoder, out = json.JSONDecoder(), []
    at = len(text) - len(text.lstrip())
    if text[at : at + 1] != "[":
        return None
    at += 1
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] == "]":
            return out, True
        if text[at] == ",":
            at += 1
            continue
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            return out, False
        if isinstance(value, dict):
            out.append(value)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def some_value(rng, depth=2):
    kinds = ["text", "number", "null", *(["list", "object"] * 2 if depth else [])]
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", "é", "😀", "a", "\n", "word "]) for _ in range(rng.randint(0, 20)))
    if kind == "list":
        return [some_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind == "object":
        return {f"k{i}{rng.choice(['', '}', '{'])}": some_value(rng, depth - 1) for i in range(rng.randint(0, 3))}
    return rng.randint(0, 99) if kind == "number" else None


ODD = ["", " ", "[]", "[", "{}", '{"a":[{"b":1}]}', "[{}]", '[{"a":1}', '[{"a":1},', '[{"a":1}, {"b":', '[{"a":1}, {"b":2]', '[{"a": tru}, {"b":1}]', '[{"a":1}] [{"b":1}]', '[{"a":1}]}{"c":1}', '[1, "x}", {"a":1}, [{"b":{}}], {"c":1}, 3]', '[,{"a":1},,{"b":1},]', '\n [ {"a":"\\\\"} , {"b":"\\"}"} ]\n', '[{"a":"x', '[{"a":{"b":{"c":[1,2,{"d":"}"}]}}}]', '[{"a":1}, "open']


def test_small_splits_give_what_a_decoder_gives(spark, small_splits, tmp_path):
    rng, wanted = random.Random(3), {}
    for k in range(20):
        text = json.dumps([some_value(rng) if rng.random() < 0.3 else {"text": some_value(rng), "n": k} for _ in range(rng.randint(0, 25))], ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1]))
        if k % 4 == 0:
            text = text[: rng.randint(1, len(text))]
        (tmp_path / f"r{k}.json").write_text(text, encoding="utf-8")
        wanted[f"r{k}.json"] = plain(text)
    for k, text in enumerate(ODD):
        (tmp_path / f"o{k}.json").write_text(text, encoding="utf-8")
        wanted[f"o{k}.json"] = plain(text)
    found = array_objects(spark, str(tmp_path))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.file, r.row_idx)):
        assert r.row_idx == len(got.setdefault(r.file, []))
        got[r.file].append((json.loads(r.record), r.whole))
    for name, value in wanted.items():
        assert got.get(name, []) == [(o, value[1]) for o in (value or ([], 0))[0]], name


def test_a_file_is_many_tasks(spark, small_splits, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": f"text {i} }}", "source": "s" if i % 2 else ""} for i in range(80)]))
    found = readers.read_json_arrays(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted((r.row_idx, r.text, r.source) for r in found.collect()) == [(i, f"text {i} }}", "s" if i % 2 else "a.json") for i in range(80)]
    assert sorted(r.row_idx for r in readers.read_json_arrays(spark, str(tmp_path), limit=7).collect()) == list(range(7))


def test_chunks_of_broken_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text":"abcd","source":"x"},{"text":"efgh","source":"y"},{"text":"i","source":"z"}]')
    (tmp_path / "b.json").write_text('[{"text":"abcd","source":"x"},{"text":"efgh","source":"y"},{"text":"i","source":"z"},{"te')
    chunks = chunk_records(readers.read_json_arrays(spark, str(tmp_path)), size=6, whole="whole")
    whole = [(0, "x", "abcd"), (1, "y", "efgh"), (2, "z", "i")]
    got = {(r.file, r.chunk, r.source, r.text) for r in chunks.collect()}
    assert got == {("a.json", *c) for c in whole} | {("b.json", *c) for c in whole[:2]}
