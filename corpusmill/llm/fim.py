"""Fill-in-the-middle: texts cut at two drawn units and laid out as prefix, suffix, middle.

Units are runs of ASCII letters and single other characters. An automaton over the bytes of the
UTF-8 form counts units and finds markers that a text holds already. Its four states are what
the last bytes can be to the next one: nothing of note, a letter, "<", or the letter of a
marker after "<". A text of over one chunk is cut into chunks that separate tasks read. A chunk's
function gives, for each state that it may be entered in, the state it is left in, its units and
its markers. Functions compose associatively: groups of chunks are composed by tasks of their own,
a text's groups in turn give the state and the number of units before each group, and from that
those before each chunk. Each chunk then finds the cuts that lie in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import buffers, cut, parts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_CONTINUED, _OTHER, _LETTER, _NAME, _OPEN, _CLOSE = range(6)
#: States: 0 nothing of note, 1 a letter, 2 "<", 3 "<" and the letter of a marker.
STATES = 4


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x80:0xC0] = _CONTINUED
    out[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
    out[list(b"PSM")] = _NAME
    out[ord("<")], out[ord(">")] = _OPEN, _CLOSE
    return out


CLASSES = _classes()
#: The next state for each state and class; units and markers that the step ends or begins.
NEXT = np.array([[0, 0, 1, 3 if s == 2 else 1, 2, 0] for s in range(STATES)])
UNITS = np.array([[0, 1, int(s in (0, 2)), int(s in (0, 2)), 1, 1] for s in range(STATES)])
MARKERS = np.array([[0, 0, 0, 0, 0, int(s == 3)] for s in range(STATES)])
#: Two classes after which the automaton is in each state.
BEFORE = np.array([[_OTHER, _OTHER], [_OTHER, _LETTER], [_OTHER, _OPEN], [_OPEN, _NAME]], np.uint8)


def steps(classes: np.ndarray, state: int) -> tuple[int, int, int]:
    """The state after some bytes, and their units and markers: the automaton as it is."""
    units = markers = 0
    for c in classes:
        units, markers, state = units + UNITS[state, c], markers + MARKERS[state, c], NEXT[state, c]
    return int(state), int(units), int(markers)


@dataclass(frozen=True)
class Scan:
    """The automaton over several texts at once, each entered in a state of its own.

    Two bytes decide its state, so all steps are worked out side by side: unit_at has where units
    begin, marker_at where markers end, begins and ends the texts' bounds.
    """

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    unit_at: np.ndarray
    marker_at: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, states: np.ndarray) -> Scan:
        own = CLASSES[data]
        begins, ends = offsets[:-1], offsets[1:]
        filled = ends > begins
        one, two = np.empty_like(own), np.empty_like(own)  # the classes one and two bytes before
        one[1:], two[2:] = own[:-1], own[:-2]
        at = begins[filled]
        one[at], two[at] = BEFORE[states[filled], 1], BEFORE[states[filled], 0]
        second = ends - begins > 1
        two[begins[second] + 1] = BEFORE[states[second], 1]
        letter = lambda c: (c == _LETTER) | (c == _NAME)
        units = (own != _CONTINUED) & ~(letter(own) & letter(one))
        markers = (own == _CLOSE) & (one == _NAME) & (two == _OPEN)
        return cls(data, begins, ends, np.flatnonzero(units), np.flatnonzero(markers))

    def units(self) -> np.ndarray:
        return np.searchsorted(self.unit_at, self.ends) - np.searchsorted(self.unit_at, self.begins)

    def markers(self) -> np.ndarray:
        return np.searchsorted(self.marker_at, self.ends) - np.searchsorted(self.marker_at, self.begins)

    def cuts(self, index: np.ndarray) -> np.ndarray:
        """Where unit ``index`` of each text begins: its end for an index past its last unit, its begin for one below 0."""
        first = np.searchsorted(self.unit_at, self.begins)
        at = np.append(self.unit_at, 0)[np.clip(first + index, 0, len(self.unit_at))]
        return np.where(index < 0, self.begins, np.where(index >= self.units(), self.ends, at))


def function_of(part: bytes) -> tuple[list[int], list[int], list[int]]:
    """A chunk's exit states, units and markers for each state that it may be entered in."""
    data = np.frombuffer(part, np.uint8)
    scan = Scan.of(data, np.array([0, len(data)]), np.zeros(1, np.int64))
    head, tail = CLASSES[data[:2]], CLASSES[data[-2:]]
    heads = [steps(head, s) for s in range(STATES)]
    exits = [s for s, _, _ in heads] if len(data) <= 2 else [steps(tail, 0)[0]] * STATES
    units, markers = int(scan.units()[0]), int(scan.markers()[0])
    return exits, [units + u - heads[0][1] for _, u, _ in heads], [markers + m - heads[0][2] for _, _, m in heads]


def composed(exits: np.ndarray, units: np.ndarray, markers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The functions (rows, in order) one after the other: what holds before each and, last, after all."""
    state, u, m = np.arange(STATES), np.zeros(STATES, np.int64), np.zeros(STATES, np.int64)
    out = [(state, u, m)]
    for e, du, dm in zip(exits, units, markers, strict=True):
        state, u, m = e[state], u + du[state], m + dm[state]
        out.append((state, u, m))
    return out


@dataclass(frozen=True)
class Layout:
    """How often a text stays plain, and which share of the others puts the suffix first, in percent."""

    plain_percent: int = 10
    suffix_first_percent: int = 20

    def form(self, n: int, markers: int, h3: int, h4: int) -> str:
        if not n or markers or h3 % 100 >= 100 - self.plain_percent:
            return "plain"
        return "spm" if h4 % 100 < self.suffix_first_percent else "psm"


def laid_out(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    first = PREFIX + prefix + SUFFIX + suffix if form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return first + MIDDLE + middle


def code_points(data: bytes) -> int:
    return int(np.count_nonzero(CLASSES[np.frombuffer(data, np.uint8)] != _CONTINUED))


_DRAWN = "h1 long, h2 long, h3 long, h4 long"
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _result(n: int, form: str, prefix: bytes, middle: bytes, suffix: bytes) -> tuple:
    chars = (None, None) if form == "plain" else (code_points(prefix), code_points(middle))
    return n, form, *chars, laid_out(form, prefix, middle, suffix).decode()


def _whole(layout: Layout):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one chunk, several at once."""
        for batch in batches:
            at = 0
            for part in parts_of(batch.column("text"), 4 << 20):
                rows = batch.slice(at, len(part))
                at += len(part)
                data, offsets = buffers(part)
                scan = Scan.of(data, offsets, np.zeros(len(part), np.int64))
                n, held = scan.units(), scan.markers()
                h1, h2, h3, h4 = (rows.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                a, b = np.sort((h1 % (n + 1), h2 % (n + 1)), axis=0)
                cuts = np.stack((offsets[:-1], scan.cuts(a), scan.cuts(b), offsets[1:]), axis=1).tolist()
                raw, found = data.tobytes(), []
                for k, (w, x, y, z) in enumerate(cuts):
                    form = layout.form(int(n[k]), int(held[k]), int(h3[k]), int(h4[k]))
                    found.append(_result(int(n[k]), form, raw[w:x], raw[x:y], raw[y:z]))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)]
                yield pa.record_batch([rows.column("doc_id"), *columns], names=["doc_id", *_ARROW.names])

    return whole


def _chunks(size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of long texts, cut between characters."""
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for k in range(batch.num_rows):
                data, _ = buffers(batch.column("text").slice(k, 1))
                own = [batch.column(c)[k].as_py() for c in ("doc_id", "h1", "h2", "h3", "h4")]
                begin = chunk = 0
                while begin < len(data):
                    end = min(begin + size, len(data))
                    while end < len(data) and CLASSES[data[end]] == _CONTINUED:
                        end += 1
                    row = [(task << 32) + number, chunk, *own]
                    names = ["row", "chunk", "doc_id", "h1", "h2", "h3", "h4"]
                    yield pa.record_batch([*(pa.array([x], pa.int64()) for x in row), pa.array([data[begin:end].tobytes()], pa.binary())], names=[*names, "part"])
                    begin, chunk = end, chunk + 1
                number += 1

    return chunks


_FUNCTION = "exits array<long>, units array<long>, markers array<long>"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [function_of(p.as_py()) for p in batch.column("part")]
        arrays = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(3)]
        yield pa.record_batch([batch.column("row"), batch.column("chunk"), *arrays], names=["row", "chunk", "exits", "units", "markers"])


def _in_order(table: pa.Table, order: str) -> tuple[pa.Table, list]:
    table = table.sort_by(order)
    return table, composed(*(np.array(table.column(c).to_pylist(), np.int64).reshape(-1, STATES) for c in ("exits", "units", "markers")))


def _composed(table: pa.Table) -> pa.Table:
    """A group of chunks as one function."""
    table, found = _in_order(table, "chunk")
    arrays = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in found[-1]]
    return pa.table([table.column("row").slice(0, 1), table.column("block").slice(0, 1), *arrays], names=["row", "block", "exits", "units", "markers"])


def _outer(table: pa.Table) -> pa.Table:
    """The state and units before each group of a text, and the text's units and markers."""
    table, found = _in_order(table, "block")
    rows, (_, n, held) = len(table), found[-1]
    columns = {"row": table.column("row"), "block": table.column("block"), "state": [int(s[0]) for s, _, _ in found[:-1]], "before": [int(u[0]) for _, u, _ in found[:-1]]}
    return pa.table(columns | {"n": [int(n[0])] * rows, "held": [int(held[0])] * rows})


def _inner(table: pa.Table, outer: pa.Table) -> pa.Table:
    """The state and units before each chunk of a group."""
    table, found = _in_order(table, "chunk")
    state, before, n, held = (outer.column(c)[0].as_py() for c in ("state", "before", "n", "held"))
    rows = len(table)
    columns = {"row": table.column("row"), "chunk": table.column("chunk"), "state": [int(s[state]) for s, _, _ in found[:-1]], "before": [before + int(u[state]) for _, u, _ in found[:-1]]}
    return pa.table(columns | {"n": [n] * rows, "held": [held] * rows})


_PLACE = "row long, chunk long, state long, before long, n long, held long"


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk cut where the text's two cuts lie in it."""
    for batch in batches:
        data, offsets = buffers(batch.column("part"))
        state, before, n, h1, h2 = (batch.column(c).to_numpy() for c in ("state", "before", "n", "h1", "h2"))
        scan = Scan.of(data, offsets, state)
        a, b = np.sort((h1 % (n + 1), h2 % (n + 1)), axis=0)
        bounds = (offsets[:-1], scan.cuts(a - before), scan.cuts(b - before), offsets[1:])
        raw = data.tobytes()
        pieces = [pa.array([raw[x:y] for x, y in zip(bounds[k].tolist(), bounds[k + 1].tolist(), strict=True)], pa.binary()) for k in range(3)]
        kept = [batch.column(c) for c in ("row", "chunk", "doc_id", "n", "held", "h3", "h4")]
        yield pa.record_batch([*kept, *pieces], names=["row", "chunk", "doc_id", "n", "held", "h3", "h4", "prefix", "middle", "suffix"])


def _assembled(layout: Layout):
    def assembled(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        doc, n, held, h3, h4 = (table.column(c)[0].as_py() for c in ("doc_id", "n", "held", "h3", "h4"))
        prefix, middle, suffix = (b"".join(table.column(c).to_pylist()) for c in ("prefix", "middle", "suffix"))
        found = _result(n, layout.form(n, held, h3, h4), prefix, middle, suffix)
        return pa.table([pa.array([doc], pa.int64()), *(pa.array([x], f.type) for x, f in zip(found, _ARROW, strict=True))], names=["doc_id", *_ARROW.names])

    return assembled


def fill_in_middle(docs: DataFrame, layout: Layout = Layout(), seed: int = 1, chunk_bytes: int = 1 << 16, group: int = 64) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs (doc_id, text).

    n is the text's units. The cuts, and the form (plain, psm or spm), follow from the SHA-256 of
    "seed:doc_id", so they don't depend on where a row lies. Texts that are null, empty or hold a
    marker stay plain (null as the empty text), and so do ``layout.plain_percent`` of the
    others; their prefix_chars and middle_chars are null. A null doc_id draws like an empty
    one; rows of one doc_id draw alike and are rows of their own. Texts of over ``chunk_bytes``
    bytes are read in chunks by separate tasks, ``group`` of them composed at a time; any
    length gives the same result as one chunk would. Other columns are ignored, whatever their
    names, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = rows.select("doc_id", "text", *(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    long_ = F.octet_length("text") > chunk_bytes
    short = drawn.where(~long_).mapInArrow(_whole(layout), f"doc_id long, {_RESULT}")
    parts = drawn.where(long_).mapInArrow(_chunks(chunk_bytes), f"row long, chunk long, doc_id long, {_DRAWN}, part binary")
    chunks = cut(parts.repartition("row", "chunk"))
    functions = cut(chunks.mapInArrow(_functions, f"row long, chunk long, {_FUNCTION}").withColumn("block", F.floor(F.col("chunk") / group)))
    blocks = functions.groupBy("row", "block").applyInArrow(_composed, f"row long, block long, {_FUNCTION}")
    outer = blocks.groupBy("row").applyInArrow(_outer, _PLACE.replace("chunk", "block"))
    places = functions.groupBy("row", "block").cogroup(outer.groupBy("row", "block")).applyInArrow(_inner, _PLACE)
    pieces = chunks.join(places, ["row", "chunk"]).mapInArrow(_selected, "row long, chunk long, doc_id long, n long, held long, h3 long, h4 long, prefix binary, middle binary, suffix binary")
    return short.union(pieces.groupBy("row").applyInArrow(_assembled(layout), f"doc_id long, {_RESULT}"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. Only plain outputs hold markers of the text's own, so the three markers split the others."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
