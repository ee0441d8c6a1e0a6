"""Sum-of-squares packing: an online algorithm that keeps few windows open at any fill level.

A task reads its documents once and in order. Whole windows of a long document are sequences of their
own; what is left of it goes to the fill level where the sum of the squared numbers of open windows grows
least, an empty window being level 0; ties go to the fullest level. ``Levels`` holds those numbers in
an array with one entry a level, and a stack of open windows for each. A window is written as soon as it is full.

The windows still open when a task ends, or as often as they hold ``CELL`` tokens (sizes that don't fit each
other would leave any number of them open), are taken apart. Their pieces, with their ids, are dealt to cells of
about ``CELL`` tokens by a hash, so what a task of either stage holds is bounded whatever the texts. A cell packs its pieces by
the same rule, the longest first, and then closes its windows: those at a power of two stay, as no padding is due
there; the fullest of the others are filled with tokens of the emptiest, cut where the window ends; the one window that is
left is cut at powers of two. So nothing is padded, and only documents in windows that stayed open are cut.

Null and empty texts are one piece with just the end id. Repeated rows are documents of their own; a null id stays null.
Documents of equal length go in the order read. Very long texts become many whole windows. An empty table gives an empty result.
Other columns, whatever their names, are not read. A task that runs again gives the same rows, as it depends on its input only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, rows
from .tokens import encoder, with_end, word_vocabulary

CAPACITY, CELL = 2048, 1 << 22


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:at]), self._replace(start=self.start + at, ids=self.ids[at:])


Window = list[Piece]


def fill(window: Window) -> int:
    return sum(len(p.ids) for p in window)


class Levels:
    """Open windows by fill level, and their numbers in an array."""

    def __init__(self, capacity: int):
        self.capacity, self.tokens = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[Window]] = [[] for _ in range(capacity)]

    def level(self, size: int) -> int:
        """The level to which a piece of ``size`` tokens, fewer than a window's, goes."""
        top = self.capacity - size
        grows = 2 * (self.counts[size:] - self.counts[: top + 1]) + 2
        grows[self.counts[: top + 1] == 0] = np.iinfo(np.int64).max
        if self.counts[top]:
            grows[top] = 1 - 2 * self.counts[top]  # a full window isn't counted
        grows[0] = 2 * self.counts[size] + 1  # nor an empty one
        return top - int(np.argmin(grows[::-1]))

    def place(self, piece: Piece) -> Window | None:
        """The window that this piece has filled, if it has."""
        size = len(piece.ids)
        at = self.level(size)
        window = self.windows[at].pop() if at else []
        self.counts[at] -= at > 0
        window.append(piece)
        if at + size == self.capacity:
            self.tokens -= at
            return window
        self.windows[at + size].append(window)
        self.counts[at + size] += 1
        self.tokens += size
        return None

    def drain(self) -> list[Window]:
        """All open windows, the fullest first; none is open afterwards."""
        out = [w for level in reversed(self.windows) for w in level]
        self.__init__(self.capacity)
        return out


def close(windows: list[Window], capacity: int) -> list[Window]:
    """Windows (the fullest first) whose fills are all ``capacity`` or a power of two, of the same pieces or parts of them."""
    out = [w for w in windows if fill(w).bit_count() == 1]
    loose = [w for w in windows if fill(w).bit_count() != 1]
    first, last = 0, len(loose) - 1
    while first < last:
        room = capacity - fill(loose[first])
        while room and last > first:
            piece = loose[last].pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                loose[last].append(rest)
            loose[first].append(piece)
            room -= len(piece.ids)
            if not loose[last]:
                last -= 1
        if not room:
            out.append(loose[first])
            first += 1
    if first == last:
        rest, room = list(reversed(loose[first])), 0
        left = fill(rest)
        while rest:
            if not room:
                room = 1 << left.bit_length() - 1
                left -= room
                out.append([])
            piece = rest.pop()
            if len(piece.ids) > room:
                piece, more = piece.cut(room)
                rest.append(more)
            out[-1].append(piece)
            room -= len(piece.ids)
    return out


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
DEALT = f"{PLACED}, uid long, ids binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in zip(range(len(names)), KINDS, strict=False)], names)


def _sequence(window: Window, number: int) -> Iterator[tuple]:
    at = 0
    for p in window:
        yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, at
        at += len(p.ids)


def _online(tokenizer: str, capacity: int, end_id: int, cell: int):
    """Documents to placed pieces, and to loose ones (without a sequence, with ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, number = encoder(tokenizer), TaskContext.get().partitionId() << 36
        levels, uid = Levels(capacity), number
        out: list[tuple] = []

        def loose() -> Iterator[tuple]:
            nonlocal uid
            for window in levels.drain():
                for p in window:
                    yield p.doc_id, p.start, len(p.ids), None, p.doc_tokens, None, None, uid, p.ids.astype("<u4").tobytes()
                    uid += 1

        for batch in rows(batches):
            every, cuts = with_end(*ids_of.encode(batch.column("text")), end_id)
            for name, a, b in zip(batch.column("doc_id").to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                for at in range(a, b, capacity):
                    piece = Piece(name, at - a, b - a, every[at : min(b, at + capacity)].copy())
                    window = levels.place(piece) if len(piece.ids) < capacity else [piece]
                    if window:
                        out += [(*r, None, None) for r in _sequence(window, number)]
                        number += 1
                    if levels.tokens >= cell:
                        out += loose()
            yield _batch(out, DEALT)
            out = []
        out += loose()
        yield _batch(out, DEALT)

    return run


def _closing(capacity: int):
    """The loose pieces of a cell to placed pieces."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number, levels, done = -1 - (key[0].as_py() << 24), Levels(capacity), []
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        for doc_id, start, doc_tokens, ids in zip(*columns, strict=True):
            window = levels.place(Piece(doc_id, start, doc_tokens, np.frombuffer(ids, "<u4")))
            if window:
                done.append(window)
        done += close(levels.drain(), capacity)
        out = [r for k, window in enumerate(done) for r in _sequence(window, number - k)]
        return pa.Table.from_batches([_batch(out, PLACED)])

    return run


def pack_online(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece; capacity is a power of two."""
    if capacity.bit_count() != 1:
        raise ValueError(f"capacity {capacity} isn't a power of two")
    ws = Workspace(spark, "online")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = ws.table("dealt", read.mapInArrow(_online(tokenizer, capacity, end_id, cell), DEALT))
    loose = dealt.where("sequence_id is null")
    cells = -(-(loose.agg(F.sum("length")).first()[0] or 0) // cell)
    names = [c.split()[0] for c in PLACED.split(", ")]
    placed = dealt.where("sequence_id is not null").select(names)
    if not cells:
        return placed
    grouped = loose.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells))).groupBy("cell")
    return placed.unionByName(grouped.applyInArrow(_closing(capacity), PLACED))


def op13_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_online(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
