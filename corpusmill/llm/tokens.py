"""Token ids by the tokenizers library, with the ids of repeated words kept in a bounded cache.

Both vocabularies used here split a text before merging, and never merge across such a split.
So a text's ids are those of its units in turn, wherever units end at such splits. The units are:

*words*: runs without a space or line feed, for tokenizers that drop white space;
*spaced*: a space or line feed with the run after it, for tokenizers that join one space to
the word after it. Texts with other white space, or several in a row, are cut before every
run of white space instead.

Many texts are encoded at once: Arrow cuts them into units and numbers the distinct ones, only
these are looked at one by one, and the ids of all units are gathered by number.

A unit of Latin-1 letters, perhaps with ASCII marks after them, splits only between the two, so
its letters go to the library's merging model at once, past its normalising and splitting, and
are kept without the marks and, where the tokenizer drops case, in lower case. Every other
unit goes through the whole library, which also finds the special tokens' strings, as it does
in whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from corpusmill.llm.common import CACHES, buffers, parts_of, release_memory, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"  # Latin-1 letters
_BEYOND = frozenset(map(chr, range(128, 256)))
_RUNS = re.compile(r"\s*\S+|\s+\Z")


def _byte_letters() -> dict[int, str]:
    """What byte-level splitters make of Latin-1 letters: each UTF-8 byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


class Recent:
    """string -> ids as little-endian 32-bit integers, in two generations of at most ``limit``: a full one becomes the old one, from which strings that come again are taken over."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def find(self, keys: list[str], make) -> list[bytes]:
        """The ids of distinct keys; ``make`` gives those of keys that are not known."""
        out = list(map(self.new.get, keys))
        lost = [i for i, x in enumerate(out) if x is None]
        unknown = []
        for i in lost:
            out[i] = self.old.get(keys[i])
            if out[i] is None:
                unknown.append(i)
        for i, ids in zip(unknown, make([keys[i] for i in unknown]), strict=True):
            out[i] = ids
        if len(self.new) + len(lost) > self.limit:
            self.old, self.new = self.new, {}
        self.new.update([(keys[i], out[i]) for i in lost])
        return out

    def forget(self) -> None:
        """Drop the old generation; the worker may serve other stages next."""
        self.old = {}


class Ids:
    """Lists of ids: ``flat`` holds them one after another, ``starts`` and ``lengths`` tell where each is."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.starts, self.lengths = flat, starts, lengths

    @classmethod
    def of(cls, found: list[bytes]) -> Ids:
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return cls(np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths, lengths)

    def take(self, index: np.ndarray) -> Ids:
        """The lists with these numbers, in turn."""
        lengths = self.lengths[index]
        return Ids(self.flat[spread(self.starts[index], lengths)], np.cumsum(lengths) - lengths, lengths)

    def joined(self, width: int) -> Ids:
        """Every ``width`` lists in a row as one; they must lie in turn."""
        lengths = self.lengths.reshape(-1, width).sum(axis=1)
        return Ids(self.flat, np.cumsum(lengths) - lengths, lengths)


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def tails(units: pa.Array, heads: pa.Array) -> pa.Array:
    """What is left of each unit after its head."""
    data, offsets = buffers(units)
    own = pc.binary_length(heads).to_numpy(zero_copy_only=False).astype(np.int64)
    left = np.diff(offsets) - own
    body = data[spread(offsets[:-1] + own, left)]
    return pa.Array.from_buffers(pa.large_string(), len(units), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(left))).tobytes()), pa.py_buffer(body.tobytes())])


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and offsets of texts, each with end_id behind it."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


class Encoder:
    """Encodes whole texts as the tokenizer at ``path`` does with add_special_tokens=False.

    Strings of special tokens become those tokens, as the library has it; with
    ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, style: str, limit: int = 120_000, special_as_text: bool = False, part_bytes: int = 2 << 20) -> None:
        if style not in ("words", "spaced"):
            raise ValueError(f"style {style!r} is neither 'words' nor 'spaced'")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or token.single_word or token.normalized or any(c.isspace() for c in token.content):
                raise ValueError(f"token {token.content!r} depends on what is around it")
        self.style, self.part_bytes, self.shown = style, part_bytes, _byte_letters()
        self.words, self.others, self.ends = Recent(limit), Recent(limit // 4), Recent(10_000)
        self.line = self._library(["\n"])[0]
        CACHES.add(self)

    def _library(self, units: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(units), 4096):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(units[a : a + 4096], add_special_tokens=False)]
        return out

    def _letters(self, keys: list[str]) -> list[bytes]:
        merge, table = self.tokenizer.model.tokenize, self.shown  # which leaves the shown space as it is
        return [array("I", [t.id for t in merge(k if k[1:].isascii() and k[0] not in _BEYOND else k.translate(table))]).tobytes() for k in keys]

    def forget(self) -> None:
        for cache in (self.words, self.others, self.ends):
            cache.forget()
        release_memory(self)

    def drop(self) -> None:
        """Give up the words, and the worker's hold on this encoder: its vocabulary goes as well once no task uses it."""
        for cache in (self.words, self.others, self.ends):
            cache.old, cache.new = {}, {}
        shared_encoder.cache_clear()

    def _units(self, units: pa.Array) -> tuple[Ids, np.ndarray]:
        """The ids of distinct units, and which units have white space that doesn't stand alone (they get no ids).

        Spaced units come without the space before them, but with a line feed.
        """
        spaced = self.style == "spaced"
        line = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False) if spaced else np.zeros(len(units), bool)
        texts = pc.ascii_ltrim(units, "\n") if spaced else units
        words = pc.ascii_rtrim(texts, _MARKS)
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(plain))
        some = words.take(at)
        keys = pc.binary_join_element_wise(pa.array(np.where(line[plain], "", self.shown[32]), pa.large_string()), some, pa.scalar("", pa.large_string())) if spaced else pc.utf8_lower(some)
        keys = keys.dictionary_encode()
        marks = tails(texts.take(at), some).dictionary_encode()
        lines = Ids.of([b"", self.line])
        heads = Ids.of(self.words.find(strings(keys.dictionary), self._letters))
        ends = Ids.of(self.ends.find(strings(marks.dictionary), self._library))
        odd, other = np.zeros(len(units), bool), np.flatnonzero(~plain)
        left = strings(texts.take(pa.array(other)))
        if spaced:
            odd[other] = [not t or t[0].isspace() or t[-1].isspace() for t in left]
            left = ["" if bad else t if l else " " + t for t, l, bad in zip(left, line[other].tolist(), odd[other].tolist(), strict=True)]
        distinct = list(dict.fromkeys(left))
        rest = Ids.of(self.others.find(distinct, self._library))
        place = {u: k for k, u in enumerate(distinct)}
        # a unit is a line feed or nothing, then a word or anything else, then marks or nothing; Ids number all of them
        flat = np.concatenate((lines.flat, heads.flat, ends.flat, rest.flat))
        shift = np.cumsum([0, len(lines.flat), len(heads.flat), len(ends.flat)])
        every = (lines, heads, ends, rest)
        table = Ids(flat, np.concatenate([x.starts + d for x, d in zip(every, shift, strict=True)]), np.concatenate([x.lengths for x in every]))
        base = np.cumsum([len(x.lengths) for x in every])
        index = np.zeros((len(units), 3), np.int64)
        index[:, 0] = line & ~odd
        index[plain, 1] = base[0] + keys.indices.to_numpy()
        index[plain, 2] = base[1] + marks.indices.to_numpy()
        index[other, 1] = base[2] + np.array([place[u] for u in left], np.int64)
        return table.take(index.ravel()).joined(3), odd

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (nulls are empty) one after another, and the offset of each text's among them, with the end of the last."""
        texts = texts.fill_null("").cast(pa.large_string())
        flat, ends = [], [np.zeros(1, np.int64)]
        for part in parts_of(texts, self.part_bytes):
            own, edges = (self._words if self.style == "words" else self._spaced)(part)
            flat.append(own)
            ends.append(edges[1:] + ends[-1][-1])
        return np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate(ends)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = units.flatten().dictionary_encode()
        found = self._units(numbered.dictionary)[0].take(numbered.indices.to_numpy())
        return found.flat, np.append(found.starts, len(found.flat))[units.offsets.to_numpy()]

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A line feed is put before each text, so that all units begin alike, and taken off its ids."""
        none = pa.scalar("", pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, none), "\n", " \n")
        units = pc.split_pattern(marked, " ")
        edges = units.offsets.to_numpy().astype(np.int64)
        numbered = units.flatten().dictionary_encode()
        table, bad = self._units(numbered.dictionary)
        index = numbered.indices.to_numpy()
        first = np.ones(len(index), bool)
        first[edges[:-1]] = False  # what is before the line feed, an empty string, goes
        found = table.take(index[first])
        edges = edges - np.arange(len(edges))
        odd = np.diff(np.concatenate(([0], np.cumsum(bad[index[first]])))[edges]) > 0
        ends = np.append(found.starts, len(found.flat))[edges]
        keep, skip = np.ones(len(found.flat), bool), len(self.line) // 4
        keep[ends[:-1][~odd, None] + np.arange(skip)] = False
        if not odd.any():
            return found.flat[keep], ends - skip * np.arange(len(ends))
        own = [found.flat[a:b][keep[a:b]] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        at = np.flatnonzero(odd).tolist()
        runs = [_RUNS.findall(t) for t in texts.take(pa.array(at)).to_pylist()]
        distinct = list(dict.fromkeys(u for r in runs for u in r))
        ids = dict(zip(distinct, self.others.find(distinct, self._library), strict=True))
        for i, r in zip(at, runs, strict=True):
            own[i] = np.frombuffer(b"".join([ids[u] for u in r]), "<u4")
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))


@lru_cache(maxsize=2)
def shared_encoder(path: str, style: str) -> Encoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    return Encoder(path, style)
