"""Fill-in-the-middle against a plain version by regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusmill.llm.fim import BEFORE, CLASSES, STATES, Layout, composed, fill_in_middle, function_of, restored, steps
from tests.llm.helpers import ODD, frame, texts


def plain_version(doc, text, layout=Layout()):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - layout.plain_percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < layout.suffix_first_percent else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def check(spark, rows, layout=Layout(), **sizes):
    from pyspark.sql import functions as F

    found = fill_in_middle(frame(spark, rows), layout, **sizes).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in found), key=repr)
    assert got == sorted(((i, plain_version(i, t, layout), t or "") for i, t in rows), key=repr)
    return found


MARKS = ["<P>", "<S", "<S>", "a<M>b", "<", "<<P>", "<P", "x<P y>", "<p>", "<PS>", "é<", "P>", "<é>", "😀<M>"]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 40, "group": 3}, {"chunk_bytes": 1, "group": 2}, {"chunk_bytes": 7, "group": 64}])
def test_short_and_long_texts(spark, sizes):
    rows = list(enumerate([t[:400] for t in texts(5, 25)] + [t and t[:300] for t in ODD] + MARKS))
    check(spark, rows + [(None, "null id text"), (None, None), (3, "again <M> id"), (3, "again")], **sizes)


def test_layouts(spark):
    rows = [(i, f"word {i}, and <more> of it") for i in range(300)]
    forms = [r.form for r in check(spark, rows)]
    assert 10 <= forms.count("plain") <= 60 and 25 <= forms.count("spm") <= 90
    assert {r.form for r in check(spark, rows, Layout(0, 100))} == {"spm"} and {r.form for r in check(spark, rows, Layout(100))} == {"plain"}


def test_giant_text(spark):
    rng = random.Random(3)
    giant = "".join(rng.choice(["word", " ", "é", "<", "P", "😀", ">x", "\n"]) for _ in range(600_000)).replace("<P>", "").replace("<P>", "")
    check(spark, [(1, giant), (2, "z" * 3_000_000), (5, giant + "<M>"), (6, "short")])


def test_empty_table(spark):
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_functions_compose_like_the_automaton():
    rng = np.random.default_rng(1)
    for _ in range(300):
        data = bytes(rng.choice(list(b"<PSMx> 1") + [0xC3, 0xA9], rng.integers(1, 12)).tolist())
        cuts = sorted(rng.integers(0, len(data) + 1, 3).tolist())
        parts = [p for p in (data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)) if p]
        exits, units, markers = composed(*(np.array(x) for x in zip(*map(function_of, parts), strict=True)))[-1]
        for s in range(STATES):
            assert steps(BEFORE[s], 0)[0] == s
            assert (exits[s], units[s], markers[s]) == steps(CLASSES[np.frombuffer(data, np.uint8)], s)
