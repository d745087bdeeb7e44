"""Tables and queries as temporary views, and operators as table functions, for use from Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from corpusmill.functions.text import SPACE
from corpusmill.plans.tables import TABLES


def _name(row: Row, part: str) -> str | None:
    """What a partition is called: the value of its column, as text."""
    return None if row[part] is None else str(row[part])


class PackTokens:
    """Windows of block + 1 ids, one id apart from the next by ``block``, over a partition's rows in order; a tail that fills no window is dropped."""

    def __init__(self) -> None:
        self.held, self.window = [], 0

    def eval(self, row: Row, block: int, part: str) -> Iterator[tuple]:
        ids = row["tokens"]
        if ids is None or len(ids) == 0:
            return
        self.held.extend(ids)
        begin = 0
        while len(self.held) - begin >= block + 1:
            yield _name(row, part), self.window, self.held[begin : begin + block + 1]
            begin, self.window = begin + block, self.window + 1
        del self.held[:begin]


class ChunkTexts:
    """A partition's texts in order, each followed by two line feeds, cut every ``size`` characters and stripped; chunks with nothing left are dropped."""

    def __init__(self) -> None:
        self.parts, self.length, self.chunk, self.part = [], 0, 0, None

    def _cut(self, whole: str) -> Iterator[tuple]:
        text = whole.strip(SPACE)
        if text:
            yield self.part, self.chunk, text
        self.chunk += 1

    def eval(self, row: Row, size: int, part: str) -> Iterator[tuple]:
        self.part = _name(row, part)
        if not row["text"]:
            return
        self.parts.append(row["text"] + "\n\n")
        self.length += len(self.parts[-1])
        if self.length >= size:
            held = "".join(self.parts)
            end = len(held) // size * size
            for a in range(0, end, size):
                yield from self._cut(held[a : a + size])
            self.parts, self.length = [held[end:]], len(held) - end

    def terminate(self) -> Iterator[tuple]:
        if self.length:
            yield from self._cut("".join(self.parts))


FUNCTIONS = {
    "pack_tokens": (PackTokens, "part string, window bigint, token_ids array<int>"),
    "chunk_texts": (ChunkTexts, "part string, chunk bigint, text string"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register the table functions; returns their names.

    ``pack_tokens(block => 512, part => 'shard', row => TABLE(t) PARTITION BY shard ORDER BY
    row_idx)`` wants a column tokens, ``chunk_texts(size => 2000, part => 'source', row =>
    TABLE(t) PARTITION BY source ORDER BY row_idx)`` a column text; ``part`` names the column that
    a partition is called by. A partition is read row by row in one task, and no more of it is held than a window and a row:
    partition by something fine (``row_idx % 1000``) where one source holds much of a table.
    The DataFrame operators of the same names have no such limit.
    """
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    return list(FUNCTIONS)


def register_views(spark: SparkSession, sf_dir: str, queries: tuple[str, ...] = (), prefix: str = "q_") -> list[str]:
    """Register the tables of sf_dir, and the named queries as views with a prefix, none of them run yet; returns the views' names.

    A query that writes files first, as the round trips do, writes them here.
    """
    from corpusmill.plans import catalogue  # whose SQL queries use this module

    unknown = sorted(set(queries) - set(catalogue.QUERIES))
    if unknown:
        raise ValueError(f"no such queries: {unknown}")
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    names = [prefix + re.sub(r"\W", "_", q) for q in queries]
    for name, query in zip(names, queries, strict=True):
        catalogue.QUERIES[query](spark, sf_dir).createOrReplaceTempView(name)
    return [*TABLES, *names]
