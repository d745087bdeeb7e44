"""Removal of byte strings that an earlier document already holds, by sorting suffixes.

Every text is a string of UTF-8 bytes. A byte goes if some 50-byte string that covers it
also starts in a document with a smaller doc_id.

Sorting every suffix of a corpus would move each byte many times over, so the suffixes are
first thinned to those that can matter:

1.  The smallest hash of the 16-byte strings inside a 50-byte window is the same wherever the
    window occurs. Windows that share it as neighbours form a *segment*; its *anchor* is the
    suffix that starts with that 16-byte string. A segment whose anchor occurs in one document
    only can't hold a repeated window. Each block of documents sends each anchor hash
    once, four bytes, to a bucket, and gets one bit back.
2.  Sampled splitters over (the anchor suffix's leading 16 bytes, doc_id) range-partition the
    segments that are left. A bucket groups them by leading bytes, sorts the suffixes of each
    group by multikey quicksort down to 50 bytes, and finds the smallest doc_id of each run of
    equal prefixes. One bit for each window goes back to the block.
3.  An anchor that a splitter names may lie on both sides of a bucket boundary, as those of
    passages found in a large part of the corpus do. Their windows are compared across
    boundaries: each block sends each distinct window once to a bucket dealt by the window's
    own hash.

Blocks are whatever documents lie together in the input, packed where they are read and written
once, compressed, to the shared folder: texts themselves are never shuffled, only packed blocks
are. A block pre-aggregates: equal segments leave it once, with their smallest doc_id, so what
one passage costs is bounded by the number of blocks and never by its copies squared.

Splitters are bounded in number. Where more buckets are needed, each range is dealt further by
a hash of the leading bytes, on which equal strings agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusmill.llm.common import NO_ID, U64, buffers, cut, ids_of, mixed, parts_of, release_memory, shared_path, spread, text_bytes

WINDOW = 50
ANCHOR = 16
_SPAN = WINDOW - ANCHOR + 1
_TILE = 1 << 17
_KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("lens", pa.binary()), ("anchors", pa.binary()), ("body", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64())), ("kept", pa.binary())])
_DDL = {_KEYS: "bucket long, block long, low binary", _REPLY: "block long, bucket long, bits binary", _SENT: "bucket long, block long, docs binary, lens binary, anchors binary, body binary", _RESULT: "doc_id long, n_bytes long, n_removed long, span_start array<long>, span_end array<long>, kept binary"}


def _words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(64, np.uint8)))
    return np.ndarray((len(padded) - 7,), kind, padded.tobytes(), strides=(1,))


def _anchor_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * U64(0x9E3779B97F4A7C15)) ^ (second * U64(0xC2B2AE3D27D4EB4F))
    h ^= h >> U64(29)
    h *= U64(0x165667B19E3779F9)
    return h


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of every segment of the documents' bytes."""
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, U64)
    words = _words(data)
    least = np.empty(n, U64)
    for a in range(0, n, _TILE):
        b = min(a + _TILE, n)
        h = _anchor_hash(words[a : b + _SPAN - 1], words[a + 8 : b + _SPAN + 7])
        width = 1
        while 2 * width <= _SPAN:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        least[a:b] = np.minimum(h[: b - a], h[_SPAN - width : _SPAN - width + b - a])
    long = np.diff(offsets) >= WINDOW
    inside = np.zeros(n + 1, np.int8)
    inside[offsets[:-1][long]] = 1
    inside[offsets[1:][long] - WINDOW + 1] = -1
    inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
    same = (least[1:] == least[:-1]) & inside[1:] & inside[:-1]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], same)))
    ends = np.flatnonzero(inside & ~np.concatenate((same, [False])))
    return starts, ends - starts + 1, least[starts]


def anchors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where in its first window each segment's anchor is."""
    words, out = _words(data), np.zeros(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 14):
        at = starts[a : a + (1 << 14), None] + np.arange(_SPAN)
        out[a : a + (1 << 14)] = np.argmin(_anchor_hash(words[at], words[at + 8]), axis=1)
    return out


def leading(data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The 16 leading bytes of suffixes followed by the document's id, ordered as bytes."""
    key = np.empty((len(at), ANCHOR + 8), np.uint8)
    key[:, :ANCHOR] = data[at[:, None] + np.arange(ANCHOR)] if len(at) else 0
    key[:, ANCHOR:] = (docs.astype(U64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return key.view(f"S{ANCHOR + 8}").ravel()


class _Block:
    """The documents of a block in id order, with their segments."""

    def __init__(self, body: pa.Scalar) -> None:
        release_memory()
        table = pa.ipc.open_stream(body.as_buffer()).read_all()
        self.carried = table.columns[2:]
        self.ids, self.docs = table.column("doc_id"), ids_of(table.column("doc_id"))
        self.data, self.offsets = buffers(table.column("text"))
        self.starts, self.lens, key = segments(self.data, self.offsets)
        self.seg_docs = self.docs[np.searchsorted(self.offsets, self.starts, "right") - 1]
        self.keys, self.key_of = np.unique(mixed(key), return_inverse=True)
        low, high = np.full(len(self.keys), NO_ID), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.key_of, self.seg_docs)
        np.maximum.at(high, self.key_of, self.seg_docs)
        self.twice = low < high

    def key_buckets(self, n: int) -> np.ndarray:
        return (((self.keys >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)

    def distinct(self, flags: np.ndarray) -> None:
        """Of the segments whose anchor is flagged, the distinct ones, each with its first document."""
        self.live = np.flatnonzero(flags[self.key_of])
        raw, found, uid = self.data.tobytes(), {}, np.empty(len(self.live), np.int64)
        for i, (a, b) in enumerate(zip(self.starts[self.live].tolist(), (self.starts + self.lens + WINDOW - 1)[self.live].tolist(), strict=True)):
            uid[i] = found.setdefault(raw[a:b], len(found))
        self.uid = uid
        _, first = np.unique(uid, return_index=True)
        self.u_start, self.u_lens, self.u_docs = (x[self.live[first]] for x in (self.starts, self.lens, self.seg_docs))

    def dealt(self, splitters: np.ndarray, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct segment its bucket and anchor, and whether a splitter names its anchor; the order of those that no splitter names, by bucket."""
        at = anchors(self.data, self.u_start)
        key = leading(self.data, self.u_start + at, self.u_docs)
        lead = lambda keys: np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, ANCHOR + 8)[:, :ANCHOR].copy()
        own = lead(key)
        crossing = np.isin(own.view(f"S{ANCHOR}").ravel(), np.unique(lead(splitters).view(f"S{ANCHOR}").ravel()))
        words = own.view("<u8").reshape(-1, 2)
        bucket = np.searchsorted(splitters, key, "right") * fine + (mixed(_anchor_hash(words[:, 0], words[:, 1])) % U64(fine)).astype(np.int64)
        order = np.flatnonzero(~crossing)
        order = order[np.argsort(key[order], kind="stable")]
        return bucket, at, crossing, order[np.argsort(bucket[order], kind="stable")]

    def windows(self, crossing: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Distinct windows of the segments that cross a boundary: bucket, two hashes, smallest document; and which one each window is."""
        at = spread(self.u_start[crossing], self.u_lens[crossing])
        docs = np.repeat(self.u_docs[crossing], self.u_lens[crossing])
        words = _words(self.data)
        h1, h2 = np.zeros(len(at), U64), np.ones(len(at), U64)
        for k in range(0, WINDOW, 8):
            w = words[at + k] if k + 8 <= WINDOW else words[at + k] & U64((1 << 8 * (WINDOW - k)) - 1)
            h1, h2 = mixed(h1 ^ (w * U64(0x9E3779B97F4A7C15))), mixed(h2 + w * U64(0xC2B2AE3D27D4EB4F) + U64(k))
        bucket = (h1 % U64(buckets)).astype(np.int64)
        order = np.lexsort((docs, h2, h1, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        return bucket[first], h1[first], h2[first], docs[first], which


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted bucket numbers."""
    if len(bucket):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(bucket[a]), a, b


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True))


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _packed(block_bytes: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, body): documents of about block_bytes each, in id order, as a compressed Arrow stream."""
        held, size, number, part = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

        for batch in batches:
            at = 0
            for texts in parts_of(batch.column("text"), max(1, block_bytes // 2)):
                held.append(batch.slice(at, len(texts)))
                at, size = at + len(texts), size + (pc.sum(pc.binary_length(texts)).as_py() or 0)
                if size >= block_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return packed


def _send_keys(n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for me, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                block = _Block(body)
                yield from _table([(k, me, block.keys[a:b].astype(np.uint32).tobytes()) for k, a, b in _slices(block.key_buckets(n_buckets))], _KEYS).to_batches()

    return send


def _find_twice(table: pa.Table) -> pa.Table:
    """One bit for each key sent: whether another block sent it as well."""
    raw, offsets = buffers(table.column("low"))
    low = np.frombuffer(raw.tobytes(), np.uint32)
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(low), bool)
    twice[order] = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
    blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    return _table([(block, bucket, np.packbits(twice[a // 4 : b // 4]).tobytes()) for block, bucket, a, b in zip(blocks, buckets, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], _REPLY)


def _send_segments(n_keys: int, splitters: np.ndarray, fine: int):
    n = (len(splitters) + 1) * fine

    def send(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _SENT)
        block, me, got = _Block(table.column("body")[0]), key[0].as_py(), _replies(replies)
        flags = block.twice.copy()
        for k, a, b in _slices(block.key_buckets(n_keys)):
            flags[a:b] |= _bits(got[k], b - a)
        rows = [(-1 - me, me, b"", b"", b"", np.packbits(flags).tobytes())]
        block.distinct(flags)
        bucket, at, crossing, order = block.dealt(splitters, fine)
        raw, packer = block.data, zstandard.ZstdCompressor(level=3)
        for k, a, b in _slices(bucket[order]):
            own = order[a:b]
            body = raw[spread(block.u_start[own], block.u_lens[own] + WINDOW - 1)]
            rows.append((k, me, block.u_docs[own].tobytes(), block.u_lens[own].astype(np.uint32).tobytes(), at[own].astype(np.uint32).tobytes(), packer.compress(body.tobytes())))
        if crossing.any():
            bucket, h1, h2, docs, _ = block.windows(np.flatnonzero(crossing), n)
            for k, a, b in _slices(bucket):
                rows.append((n + k, me, docs[a:b].tobytes(), b"", b"", np.stack((h1[a:b], h2[a:b]), 1).tobytes()))
        return _table(rows, _SENT)

    return send


def equal_prefixes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first 50 bytes, and the run of equal prefixes that each sorted one is in.

    A multikey quicksort over eight bytes at a time: each pass sorts by the next eight bytes
    within groups that are still equal, and suffixes that stand alone drop out.
    """
    order, run = np.arange(len(at)), np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for depth in range(0, WINDOW, 8):
        key = words[at[order[open_]] + depth]
        if depth + 8 > WINDOW:
            key = key & ~U64((1 << 8 * (depth + 8 - WINDOW)) - 1)
        by = np.argsort(key) if depth == 0 else np.lexsort((key, run[open_]))
        order[open_], key, group = order[open_][by], key[by], run[open_][by]
        new = np.ones(len(open_), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        run[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        alone = new & np.concatenate((new[1:], [True]))
        open_ = open_[~alone]
        if not len(open_):
            break
    return order, run


def _sort_segments(table: pa.Table) -> pa.Table:
    release_memory()
    docs = np.frombuffer(buffers(table.column("docs"))[0].tobytes(), np.int64)
    lens = np.frombuffer(buffers(table.column("lens"))[0].tobytes(), np.uint32).astype(np.int64)
    at = np.frombuffer(buffers(table.column("anchors"))[0].tobytes(), np.uint32).astype(np.int64)
    unpacker = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join(unpacker.decompress(x) for x in table.column("body").to_pylist()), np.uint8)
    ends = np.cumsum(lens + WINDOW - 1)
    starts = ends - lens - WINDOW + 1
    raw, bodies, leads = data.tobytes(), {}, {}
    uid, lead = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    for i, (a, b, c) in enumerate(zip(starts.tolist(), ends.tolist(), (starts + at).tolist(), strict=True)):
        uid[i] = bodies.setdefault(raw[a:b], len(bodies))
        lead[i] = leads.setdefault(raw[c : c + ANCHOR], len(leads))
    least = np.full(len(bodies), NO_ID)
    np.minimum.at(least, uid, docs)
    _, first = np.unique(uid, return_index=True)
    mixed_lead = np.bincount(lead[first], minlength=len(leads)) > 1
    sorted_ = np.flatnonzero(mixed_lead[lead[first]])  # bodies that share their leading bytes with another body
    u_lens = lens[first]
    window = np.concatenate(([0], np.cumsum(u_lens)))[:-1]
    w_doc = np.repeat(least, u_lens)
    if len(sorted_):
        own = spread(window[sorted_], u_lens[sorted_])
        order, run = equal_prefixes(_words(data, ">u8").astype(U64), spread(starts[first[sorted_]], u_lens[sorted_]))
        heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        best = np.minimum.reduceat(w_doc[own][order], heads)
        w_doc[own[order]] = np.repeat(best, np.diff(np.concatenate((heads, [len(order)]))))
    earlier = w_doc[spread(window[uid], lens)] < np.repeat(docs, lens)
    _, by_row = buffers(table.column("docs"))
    edge = np.concatenate(([0], np.cumsum(lens)))[by_row // 8]
    return _table([(block, bucket, np.packbits(earlier[a:b]).tobytes()) for block, bucket, a, b in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)], _REPLY)


def _match_windows(table: pa.Table) -> pa.Table:
    docs = np.frombuffer(buffers(table.column("docs"))[0].tobytes(), np.int64)
    hashes = np.frombuffer(buffers(table.column("body"))[0].tobytes(), U64).reshape(-1, 2)
    order = np.lexsort((docs, hashes[:, 1], hashes[:, 0]))
    heads = np.flatnonzero(np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]).any(axis=1))))
    least = np.empty(len(docs), np.int64)
    least[order] = np.repeat(docs[order][heads], np.diff(np.concatenate((heads, [len(order)]))))
    earlier = least < docs
    _, by_row = buffers(table.column("docs"))
    return _table([(block, bucket, np.packbits(earlier[a:b]).tobytes()) for block, bucket, a, b in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), (by_row[:-1] // 8).tolist(), (by_row[1:] // 8).tolist(), strict=True)], _REPLY)


def _answer(n: int):
    def answer(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:  # what a block tells itself
            return table.select(["block", "bucket", "body"]).rename_columns(_REPLY.names)
        return _match_windows(table) if bucket >= n else _sort_segments(table)

    return answer


def _whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """covered, without UTF-8 characters that are covered in part."""
    character = np.cumsum((data & 0xC0) != 0x80)
    left = np.zeros(int(character[-1]) + 1 if len(character) else 1, bool)
    left[character[~covered]] = True
    return ~left[character]


def _finish(splitters: np.ndarray, fine: int, characters: bool, names: list[str], carried: pa.Schema):
    n = (len(splitters) + 1) * fine

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in _RESULT] + [pa.array([], carried.field(c).type) for c in names], names=[*_RESULT.names, *names])
        block, me, got = _Block(table.column("body")[0]), key[0].as_py(), _replies(replies)
        block.distinct(_bits(got[-1 - me], len(block.keys)))
        bucket, _, crossing, order = block.dealt(splitters, fine)
        window = np.concatenate(([0], np.cumsum(block.u_lens)))[:-1]
        gone = np.zeros(int(block.u_lens.sum()), bool)
        for k, a, b in _slices(bucket[order]):
            own = order[a:b]
            gone[spread(window[own], block.u_lens[own])] = _bits(got[k], int(block.u_lens[own].sum()))
        if crossing.any():
            own = np.flatnonzero(crossing)
            bucket, _, _, docs, which = block.windows(own, n)
            bits = np.zeros(len(docs), bool)
            for k, a, b in _slices(bucket):
                bits[a:b] = _bits(got[n + k], b - a)
            gone[spread(window[own], block.u_lens[own])] = bits[which] | (docs[which] < np.repeat(block.u_docs[own], block.u_lens[own]))
        size = len(block.data)
        change = np.zeros(size + 1, np.int32)
        later = block.seg_docs[block.live] > block.u_docs[block.uid]
        np.add.at(change, block.starts[block.live[later]], 1)
        np.add.at(change, (block.starts + block.lens + WINDOW - 1)[block.live[later]], -1)
        live, uid = block.live[~later], block.uid[~later]
        at = spread(block.starts[live], block.lens[live])[gone[spread(window[uid], block.lens[live])]]
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
        covered = np.cumsum(change)[:size] > 0
        if characters:
            covered = _whole_characters(block.data, covered)
        edge = np.zeros(size + 1, bool)
        edge[block.offsets] = True
        before, after = np.concatenate(([False], covered[:-1])), np.concatenate((covered[1:], [False]))
        begin = np.flatnonzero(covered & (~before | edge[:size])) if size else np.zeros(0, np.int64)
        end = np.flatnonzero(covered & (~after | edge[1:])) + 1 if size else np.zeros(0, np.int64)
        spans = np.searchsorted(begin, block.offsets)
        base = np.repeat(block.offsets[:-1], np.diff(spans))
        left = np.concatenate(([0], np.cumsum(~covered)))[block.offsets]
        lists = [pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(x - base, pa.int64())) for x in (begin, end)]
        kept = pa.Array.from_buffers(pa.binary(), len(left) - 1, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(block.data[~covered].tobytes())])
        n_bytes = np.diff(block.offsets)
        return pa.table([block.ids.cast(pa.int64()), pa.array(n_bytes), pa.array(n_bytes - np.diff(left)), *lists, kept, *block.carried], names=[*_RESULT.names, *names])

    return finish


def _sample(every: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            starts, _, key = segments(data, offsets)
            row = np.searchsorted(offsets, starts, "right") - 1
            docs = ids_of(batch.column("doc_id"))[row]
            place = mixed(docs.astype(U64) + mixed((starts - offsets[row]).astype(U64)))
            some = mixed(key ^ place) % U64(every) == 0
            starts, docs = starts[some], docs[some]
            yield pa.RecordBatch.from_arrays([pa.array([leading(data, starts + anchors(data, starts), docs).tobytes()], pa.binary())], ["keys"])

    return sample


def splitters_of(docs: DataFrame, buckets: int, total: int, sample_bytes: int) -> np.ndarray:
    """Splitters between buckets, from the anchors of a sample of documents of about sample_bytes, each place chosen by itself, so that frequent anchors come up as often as they occur; only balance depends on it."""
    if buckets < 2:
        return np.zeros(0, f"S{ANCHOR + 8}")
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // sample_bytes))) == 0)
    found = np.frombuffer(b"".join(r[0] for r in some.mapInArrow(_sample(8), "keys binary").toLocalIterator()), f"S{ANCHOR + 8}")
    found = np.sort(found)
    return np.unique(found[np.linspace(0, len(found) - 1, buckets + 1).astype(int)[1:-1]]) if len(found) >= buckets else np.unique(found)


def suffix_dedup(docs: DataFrame, carry: tuple[str, ...] = (), characters: bool = False, block_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20, sample_bytes: int = 16 << 20, most_ranges: int = 1 << 16, part_bytes: int = 32 << 20) -> DataFrame:
    """For each row of docs (doc_id, text): n_bytes, n_removed, the removed byte runs and the bytes kept, then the columns in ``carry``.

    With ``characters``, a character goes only if all its bytes do. Null texts are
    empty. Texts below 50 bytes lose nothing; a text of any length is read whole, in one block.
    Rows with the same doc_id don't remove each other's strings (neither id is smaller), so
    repeated rows all stay; a null doc_id counts as larger than any. An empty
    table gives an empty result. Carried columns may have any names, those of the result
    included; other columns are ignored. There are at most ``most_ranges`` ranges of leading
    bytes, whatever the table's size.
    """
    spark, names = docs.sparkSession, [f"_carried_{i}" for i in range(len(carry))]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)))
    docs = every.select("doc_id", "text")
    total = text_bytes(docs, "text")
    n_keys, wanted = (max(1, total // size + 1) for size in (16 * bucket_bytes, bucket_bytes))
    n_ranges = min(wanted, most_ranges)
    fine = -(-wanted // n_ranges)
    splitters = splitters_of(docs, n_ranges, total, min(sample_bytes, n_ranges << 18))
    n = (len(splitters) + 1) * fine
    path = shared_path(spark, "blocks")
    every.mapInArrow(_packed(block_bytes), "block long, body binary").write.option("compression", "none").parquet(path)
    blocks = spark.read.schema("block long, body binary").parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_bytes)  # so that tasks don't grow with the table
    dealt = lambda df, key: df.repartition(parts, key).groupBy(key)
    twice = dealt(blocks.mapInArrow(_send_keys(n_keys), _DDL[_KEYS]), "bucket").applyInArrow(_find_twice, _DDL[_REPLY])
    sent = dealt(blocks, "block").cogroup(dealt(twice, "block")).applyInArrow(_send_segments(n_keys, splitters, fine), _DDL[_SENT])
    replies = cut(dealt(sent, "bucket").applyInArrow(_answer(n), _DDL[_REPLY]))
    schema = StructType([*StructType.fromDDL(_DDL[_RESULT]).fields, *(every.schema[x] for x in names)])
    carried = to_arrow_schema(StructType([every.schema[x] for x in names]))
    found = dealt(blocks, "block").cogroup(dealt(replies, "block")).applyInArrow(_finish(splitters, fine, characters, names, carried), schema)
    return found.toDF(*_RESULT.names, *carry)
