"""SentencePiece encoding and decoding, with giant documents encoded chunk by chunk in parallel.

A byte-pair encoding is the one sequence of pieces in which every two neighbours are stable:
their joined text encodes to just these two. So encoding is a best path in the (max, +)
semiring, with weight 0 for stable neighbours and minus infinity for others, and exactly one
path has weight 0.

For a giant document the state at a cut is the piece that starts before it and ends at or
after it. Each chunk turns the states at its left cut into those at its right cut, a matrix of
zeros and minus infinities that needs only the chunk and a few characters around it. The
matrices combine associatively, in pairs: those of neighbouring chunks in tasks of their own to
one for each group of chunks, these to the document's. Products from the left and from the right
give the one state at every cut, of the groups first and then of the chunks inside each, and
each chunk is then backtraced on its own.

Inside a chunk, and in documents below a chunk's size, text falls apart where two characters
are neighbours in no piece. No piece crosses such a place, the matrix has rank one there, and
the parts' ids come from the library through a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
NO_WAY = -np.inf
State = tuple[int, int]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) matrix product."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), NO_WAY)
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


class Pieces:
    """A byte-pair SentencePiece model with byte fallback, a leading space and no other normalisation."""

    def __init__(self, path: str, limit: int = 150_000) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, self.limit = self.model, limit
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        own = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not special(i)}
        self.ids, self.scores = own, {p: model.get_score(i) for p, i in own.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, own))
        self.joined = {p[i : i + 2] for p in own for i in range(len(p) - 1)}
        if any(x in self.joined for x in ("\n\n",)) or any(y == SPACE and x != SPACE or "\n" in (x, y) for x, y in self.joined):
            raise ValueError("a piece of this model holds a line feed, or a space after another character")
        self.stable: dict[tuple[str, str], bool] = {}
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.shown = [b""] * model.get_piece_size()
        for p, i in own.items():
            self.shown[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.shown[i] = bytes([b])

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours again and again."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(((self.scores.get(a + b, NO_WAY), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if score == NO_WAY:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        if a[-1] + b[0] not in self.joined:
            return True
        if (a, b) not in self.stable:
            if len(self.stable) > self.limit:
                self.stable.clear()
            self.stable[a, b] = self.merge(a + b) == [a, b]
        return self.stable[a, b]

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def learn(self, units: set[str]) -> None:
        new = units - self.units.keys()
        if len(self.units) + len(new) > self.limit:
            self.old, self.units, new = self.units, {}, units
        kept = {u: self.old[u] for u in new if u in self.old} | {SPACE: array("I", self.ids_of(SPACE)).tobytes()}
        self.units.update(kept)
        new = list(new - kept.keys())
        line = len(self.model.encode("\n"))
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            # the library puts one space before a text; a line feed keeps it apart from units that don't begin with one
            found = self.model.encode([u[1:] if u[0] == SPACE else "\n" + u for u in some], num_threads=1)
            self.units.update(zip(some, [array("I", ids if u[0] == SPACE else ids[line:]).tobytes() for u, ids in zip(some, found, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        units = [_UNITS.findall(marked(t)) for t in texts]
        self.learn({u for own in units for u in own})
        get = self.units.__getitem__
        return [b"".join(map(get, own)) for own in units]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.shown.__getitem__, array("I", ids))).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    def breaks(self, text: str, start: int, stop: int) -> list[int]:
        """Where in [start, stop] a piece can't cross."""
        return [i for i in range(max(1, start), min(stop, len(text) - 1) + 1) if text[i - 1 : i + 1] not in self.joined]

    def starting(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at ``at``."""
        yield at + 1
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if text[at:end] in self.ids:
                yield end

    def states(self, text: str, at: int) -> list[State]:
        """The pieces that start before ``at`` and end at or after it."""
        return [(i, j) for i in range(max(0, at - self.longest), at) for j in self.starting(text, i) if j >= at]

    def paths(self, text: str, entries: dict[State, int], stop: int) -> dict[State, tuple[int, list[State]]]:
        """All pieces that stable neighbours reach from the entries, up to those that end at or after ``stop``: the set of entries, as bits, and the pieces before."""
        reached: dict[State, tuple[int, list[State]]] = {s: (bit, []) for s, bit in entries.items()}
        ending: dict[int, list[State]] = {}
        for s in entries:
            ending.setdefault(s[1], []).append(s)
        for at in range(min(ending, default=stop), stop):
            for end in self.starting(text, at) if at in ending else ():
                before = [s for s in ending[at] if s == (at, at) or self.follows(text[s[0] : at], text[at:end])]
                if before:
                    bits = 0
                    for s in before:
                        bits |= reached[s][0]
                    reached[at, end] = (bits, before)
                    ending.setdefault(end, []).append((at, end))
        return reached

    def transfer(self, text: str, left: int, right: int) -> tuple[list[State], list[State], np.ndarray]:
        """States at the cuts ``left`` and ``right`` of a text, and the matrix from the former to the latter. At 0 the state is (0, 0)."""
        entries = self.states(text, left) if left else [(0, 0)]
        exits = self.states(text, right)
        bits = {s: 1 << k for k, s in enumerate(entries)}
        inner = self.breaks(text, left + self.longest, right - self.longest)
        if inner:
            found = self.paths(text, bits, inner[0])
            through = 0
            for (_, end), (own, _) in found.items():
                through |= own if end == inner[0] else 0
            bits = {(inner[-1], inner[-1]): through}
        found = self.paths(text, bits, right)
        matrix = np.full((len(entries), len(exits)), NO_WAY)
        for j, s in enumerate(exits):
            own = found.get(s, (0, []))[0]
            matrix[[k for k in range(len(entries)) if own >> k & 1], j] = 0
        return entries, exits, matrix

    def between(self, text: str, entry: State, exit_: State, left: int, right: int) -> bytes:
        """Ids of the pieces after ``entry`` up to ``exit_``, the states at a chunk's two cuts."""
        inner = self.breaks(text, left + self.longest, right - self.longest)
        if not inner:
            return self._back(text, self.paths(text, {entry: 1}, right), exit_)
        found = self.paths(text, {entry: 1}, inner[0])
        head = next(s for s in found if s[1] == inner[0])
        units = _UNITS.findall(text[inner[0] : inner[-1]])
        self.learn(set(units))
        first, last = (inner[0], inner[0]), (inner[-1], inner[-1])
        middle = b"".join(map(self.units.__getitem__, units)) if first != last else b""
        return self._back(text, found, head) + middle + self._back(text, self.paths(text, {last: 1}, right), exit_)

    def _back(self, text: str, found: dict[State, tuple[int, list[State]]], state: State) -> bytes:
        out = []
        while found[state][1]:
            out.append(state)
            state = found[state][1][0]
        return array("I", [i for a, b in reversed(out) for i in self.ids_of(text[a:b])]).tobytes()


def marked(text: str) -> str:
    """The text as the model sees it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The products of the first 1, 2, ... matrices, from products of pairs."""
    if len(matrices) == 1:
        return matrices
    pairs = scan([product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], matrices[k]))
    return out


def total(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of all matrices, from products of pairs."""
    while len(matrices) > 1:
        last = matrices[-1:] if len(matrices) % 2 else []
        matrices = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)] + last
    return matrices[0]


def between_cuts(matrices: list[np.ndarray], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states at the two cuts of each matrix, on the one path from an entry of the first to an exit of the last."""
    before = [m[entry] for m in scan(matrices)[:-1]]
    after = [m.T[:, exit_] for m in scan([m.T for m in reversed(matrices)])[:-1]][::-1] if len(matrices) > 1 else []
    at = [entry, *(int(np.argmax(a + b)) for a, b in zip(before, after, strict=True)), exit_]
    return list(zip(at[:-1], at[1:], strict=True))


def resolve(transfers: list[tuple[list[State], list[State], np.ndarray]], end: int) -> list[tuple[State, State]]:
    """The states at the two cuts of every chunk of a text of length ``end``, from the chunks' matrices in order."""
    matrices, exits = [m for _, _, m in transfers], transfers[-1][1]
    ways = total(matrices)[0]
    last = next(k for k, s in enumerate(exits) if s[1] == end and ways[k] == 0)
    return [(entries[a], exits[b]) for (entries, exits, _), (a, b) in zip(transfers, between_cuts(matrices, 0, last), strict=True)]


def _whole(path: str):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            ids = [x for a in range(0, len(texts), 256) for x in model.encode(texts[a : a + 256])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return whole


def _transfers(path: str):
    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shift = r["base"]
                entries, exits, matrix = model.transfer(r["part"], r["left"] - shift, r["right"] - shift)
                flat = lambda states, shift=shift: [x + shift for s in states for x in s]
                rows.append({"row": r["row"], "chunk": r["chunk"], "size": r["size"], "entries": flat(entries), "exits": flat(exits), "ways": np.packbits(matrix == 0).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("entries", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64())), ("ways", pa.binary())]))

    return transfers


def _matrices(table: pa.Table, order: str) -> tuple[list[dict], list[tuple[list[State], list[State], np.ndarray]]]:
    rows = table.sort_by(order).to_pylist()
    pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
    out = []
    for r in rows:
        a, b = pairs(r["entries"]), pairs(r["exits"])
        ways = np.unpackbits(np.frombuffer(r["ways"], np.uint8), count=len(a) * len(b)).reshape(len(a), len(b))
        out.append((a, b, np.where(ways, 0.0, NO_WAY)))
    return rows, out


def _combined(table: pa.Table) -> pa.Table:
    """A group of chunks as one matrix."""
    rows, transfers = _matrices(table, "chunk")
    matrix = total([m for _, _, m in transfers])
    return pa.table({"row": [rows[0]["row"]], "block": [rows[0]["block"]], "size": [rows[0]["size"]], "entries": pa.array([rows[0]["entries"]], pa.list_(pa.int64())), "exits": pa.array([rows[-1]["exits"]], pa.list_(pa.int64())), "ways": pa.array([np.packbits(matrix == 0).tobytes()], pa.binary())})


def _resolved(table: pa.Table) -> pa.Table:
    """The states at the two cuts of each group of a document's chunks."""
    rows, transfers = _matrices(table, "block")
    found = resolve(transfers, rows[0]["size"])
    return pa.table({"row": [r["row"] for r in rows], "block": [r["block"] for r in rows], "states": pa.array([[*a, *b] for a, b in found], pa.list_(pa.int64()))})


def _inside(table: pa.Table, outer: pa.Table) -> pa.Table:
    """The states at the two cuts of each chunk of a group."""
    rows, transfers = _matrices(table, "chunk")
    a, b, c, d = outer.column("states")[0].as_py()
    places = between_cuts([m for _, _, m in transfers], transfers[0][0].index((a, b)), transfers[-1][1].index((c, d)))
    states = [[*entries[x], *exits[y]] for (entries, exits, _), (x, y) in zip(transfers, places, strict=True)]
    return pa.table({"row": [r["row"] for r in rows], "chunk": [r["chunk"] for r in rows], "states": pa.array(states, pa.list_(pa.int64()))})


def _chunks(size: int, context: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each giant text's chunks with what is around them, each text cut in one pass."""
        number, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = marked(text.as_py())
                for chunk, left in enumerate(range(0, len(text), size)):
                    right, base = min(left + size, len(text)), max(0, left - context)
                    row = [(part << 32) + number, doc, len(text), chunk, left, right, base]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([text[base : right + context]], pa.string())], [c.split()[0] for c in _CHUNK.split(", ")])
                number += 1

    return chunks


_CHUNK = "row long, doc_id long, size long, chunk long, left long, right long, base long, part string"


def _joined(table: pa.Table) -> pa.Table:
    ordered = table.sort_by("chunk")
    return pa.table({"row": [ordered.column("row")[0].as_py()], "ids": pa.array([b"".join(ordered.column("ids").to_pylist())], pa.binary())})


def _backtrace(path: str):
    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b, c, d = (x - r["base"] for x in r["states"])
                rows.append({"row": r["row"], "chunk": r["chunk"], "ids": model.between(r["part"], (a, b), (c, d), r["left"] - r["base"], r["right"] - r["base"])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary())]))

    return backtrace


def encode_pieces(docs: DataFrame, model: str, chunk_chars: int = 1 << 16, context: int = 64, group: int = 64) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text): the model's ids as little-endian 32-bit integers.

    Texts of over chunk_chars characters are cut into chunks that separate tasks encode, and
    ``group`` chunks' matrices are combined by a task of their own.
    ``context`` characters around a chunk must hold the longest piece twice. Null and empty
    texts have no ids; repeated rows and null doc_ids keep their rows; other columns are
    ignored, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(_whole(model), "doc_id long, ids binary")
    giant = rows.where(F.length("text") > chunk_chars)
    chunks = cut(giant.mapInArrow(_chunks(chunk_chars, context), _CHUNK).repartition("row", "chunk"))
    found = chunks.mapInArrow(_transfers(model), "row long, chunk long, size long, entries array<long>, exits array<long>, ways binary").withColumn("block", F.floor(F.col("chunk") / group))
    found = cut(found)
    blocks = found.groupBy("row", "block").applyInArrow(_combined, "row long, block long, size long, entries array<long>, exits array<long>, ways binary")
    outer = blocks.groupBy("row").applyInArrow(_resolved, "row long, block long, states array<long>")
    states = found.groupBy("row", "block").cogroup(outer.groupBy("row", "block")).applyInArrow(_inside, "row long, chunk long, states array<long>")
    ids = chunks.join(states, ["row", "chunk"]).mapInArrow(_backtrace(model), "row long, chunk long, ids binary")
    joined = ids.groupBy("row").applyInArrow(_joined, "row long, ids binary")
    return short.union(chunks.where("chunk = 0").select("row", "doc_id").join(joined, "row").select("doc_id", "ids"))


def _decoded(path: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), crc, pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text"])

    return decoded


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and text of every row of encoded (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, n_tokens long, ids_crc32 long, text string")
