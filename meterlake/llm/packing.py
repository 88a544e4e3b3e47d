"""Packing of token sequences: best-fit decreasing over windows of a fixed size.

A document is cut into full windows first; what is left of it, shorter than a window, is placed
with others. A segment tree over the remaining capacities finds the tightest open window.
Texts are encoded once, and their pieces, without their ids, stored. The remainders among them are
counted and dealt by a hash of their number into groups of about ``BLOCK``, however the input is
partitioned; each group is packed by itself, so only its last few windows are padded more than best fit needs.

Defined results: a null text is the empty text (its only id is the separator); repeated rows are
packed once each; an empty table gives no rows; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import tokens
from meterlake.llm.common import release, stored

WINDOW = 1024
SEPARATOR = 0
#: Remainders that are packed together, about, and pieces in a batch.
BLOCK = 65_536
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECE}, sequence_id long, offset long, sequence_length long"
#: Sequences of remainders are numbered from here, by group and then by window.
PLACED = 1 << 62


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, window_id: int, capacity: int) -> None:
        if capacity:
            self.at[capacity].append(window_id)
            self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window of the least capacity that is at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[tuple[int, int]], list[int]]:
    """For each length its (window, offset), and for each window how much of it is filled.

    Equal lengths are placed in their given order.
    """
    free, fill = OpenWindows(window), []
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        found = free.tightest(n)
        if found is None:
            fill.append(0)
            found = len(fill) - 1, window
        w, capacity = found
        places[i] = w, window - capacity
        fill[w] += n
        free.put(w, capacity - n)
    return places, fill


def padded(fill: int, window: int) -> int:
    """A sequence is padded to the window, except when its length is a power of two."""
    return fill if fill & (fill - 1) == 0 else window


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _cut(batches: Iterator, path: str, window: int, separator: int) -> Iterator:
    """The pieces of documents, each with a number of its own."""
    from pyspark import TaskContext

    words, end = tokens.words_of(path), separator.to_bytes(4, "little")
    number = TaskContext.get().partitionId() << 36
    rows: list[tuple] = []
    for given in batches:
        for doc_id, ids in zip(given.column(0).to_pylist(), tokens.packed(given.column(1), words), strict=True):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, number))
                number += 1
            if len(rows) >= BLOCK:
                yield _batch(rows, f"{PIECE}, number long")
                rows.clear()
    if rows:
        yield _batch(rows, f"{PIECE}, number long")
    release()


def _placed(batches: Iterator, window: int) -> Iterator:
    """From remainders with their group, ordered by it, the remainders with their places."""
    given = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for group, some in groupby(given, key=lambda r: r[-1]):
        rows = [r[:-1] for r in some]
        places, fill = best_fit_decreasing([r[2] for r in rows], window)
        base = PLACED + (group << 32)
        yield _batch([(*r, base + w, at, padded(fill[w], window)) for r, (w, at) in zip(rows, places, strict=True)], SCHEMA)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece of a document, with its sequence and its place in that."""
    path = path or tokens.default_path()
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(given.mapInArrow(lambda batches: _cut(batches, path, window, separator), f"{PIECE}, number long"), "pieces")
    names = [x.split()[0] for x in PIECE.split(", ")]
    full = F.col("length") == window
    groups = max(1, round(pieces.where(~full).count() / BLOCK))
    rest = pieces.where(~full).select(*names, F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group"))
    placed = rest.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _placed(batches, window), SCHEMA)
    whole = pieces.where(full).select(*names, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("sequence_length"))
    return whole.unionAll(placed)
