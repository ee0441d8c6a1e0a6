"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. Seeds are runs of ``MIN_MATCH`` words that a document
shares with a benchmark item, joined on their rolling hash. Where the seeds cover enough of an item,
greedy string tiling runs: the longest runs of unmarked words that both texts have are marked first in both, then
the next longest, down to ``MIN_MATCH``. Karp-Rabin finds the runs of one length: prefix sums give the rolling hash of every
window at once, and as a shorter run exists wherever a longer one does, the greatest length is found by bisection. Tiles don't
overlap and their order is free, so reordered passages count. An item leaks into a document if tiles cover at
least ``COVERAGE`` of the item's words.

Each seed of a document is looked up once, whatever the number of items that have it, and the covered words of all
items are counted with arrays before any is tiled. Of several items of which a document has the same seeds, one is tiled.

The benchmark is taken in blocks of a checked size; each is indexed once and broadcast, and the documents
are read once for each block and not shuffled, so no key can be hot. Items of fewer than ``MIN_MATCH`` words never match. Null and
empty texts match nothing. Repeated items are reported each, repeated documents each. An empty
documents or benchmark table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows, texts
from .textbytes import STEP, mixed

MIN_MATCH, COVERAGE, BLOCK_BYTES = 5, 0.6, 8 << 20
WORD = re.compile(r"[^\W_]+")
#: Odd, so that powers have inverses modulo 2**64.
INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Rolling:
    """Karp-Rabin hashes, modulo 2**64, of the windows of some words; negative words match nothing."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        with np.errstate(over="ignore"):
            up, self.down = np.full(self.n, STEP), np.full(self.n, INVERSE)
            up[:1] = self.down[:1] = 1
            up, self.down = np.cumprod(up), np.cumprod(self.down)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64)) * up, dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[n:] - self.sums[:-n]) * self.down[: self.n - n + 1] if self.n >= n else np.zeros(0, np.uint64)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Where windows of ``n`` words without marks begin."""
    run = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(run[n:] == run[:-n])


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(item position, text position, length) of greedy tiles. Negative ids match nothing."""
    a, b, out = item < 0, text < 0, []
    left, right = Rolling(item), Rolling(text)

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of ``n`` words that both have: their places and hashes."""
        i, j = _free(a, n), _free(b, n)
        x, y = left.windows(n)[i], right.windows(n)[j]
        here, there = np.isin(x, y), np.isin(y, x)
        return i[here], x[here], j[there], y[there]

    def longest(most: int) -> int:
        """The greatest length of a run that both have free: all, as a rule, or else by bisection; 0 if it is below ``least``."""
        if most < least or len(common(most)[0]):
            return most if most >= least else 0
        low, high = least - 1, most - 1
        while low < high:
            middle = (low + high + 1) // 2 if low >= least else least
            if len(common(middle)[0]):
                low = middle
            elif middle == least:
                return 0
            else:
                high = middle - 1
        return low if low >= least else 0

    n = longest(min(len(item), len(text)))
    while n:
        i, x, j, y = common(n)
        places: dict[int, list[int]] = {}
        for h, k in zip(y[::-1].tolist(), j[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(k)
        for k, h in zip(i.tolist(), x.tolist(), strict=True):
            # all windows were free, so one of equal length that a new tile cuts has a mark at an end
            if a[k] or a[k + n - 1]:
                continue
            at = places.get(h, [])
            while at:
                t = at.pop()
                if not (b[t] or b[t + n - 1]) and (item[k : k + n] == text[t : t + n]).all():
                    a[k : k + n] = b[t : t + n] = True
                    out.append((k, t, n))
                    break
        n = longest(n - 1)
    return out


def _union(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``size`` words lie within ``n`` words of a start."""
    step = np.bincount(starts, minlength=size + 1) - np.bincount(np.minimum(starts + n, size), minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def _condensed(ids: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The kept words, with a mark between stretches."""
    edge = ~kept & np.concatenate([[False], kept[:-1]])
    return np.where(kept, ids, -1)[kept | edge]


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        self.names, every, hashes, places = [], [], [], []
        at = 0
        for name, text in items:
            found = words(text or "")
            if len(found) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64)
            own = Rolling(ids).windows(least)
            hashes.append(own)
            places.append(at + np.arange(len(own)))
            self.names.append(name)
            every.append(ids)
            at += len(ids)
        self.least = least
        self.words = np.concatenate(every) if every else np.zeros(0, np.int64)
        self.cuts = np.cumsum([0, *map(len, every)])
        hashes, places = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, places))
        order = np.argsort(hashes, kind="stable")
        # the distinct seeds, and where in ``places`` the words at which each begins are listed
        self.seeds, first = np.unique(hashes[order], return_index=True)
        self.first, self.places = np.append(first, len(order)), places[order].astype(np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def leaks(self, text: str, coverage: float) -> list[tuple[int, int, int, float]]:
        """(item, its words, tiled words, coverage) of the items that leak into a text."""
        found, get, least = words(text), self.vocabulary.get, self.least
        if len(found) < least or not len(self.seeds):
            return []
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        spots = _free(ids < 0, least)
        hashes = Rolling(ids).windows(least)[spots] if len(spots) else np.zeros(0, np.uint64)
        hit = self.bits[(hashes >> np.uint64(44)).astype(np.int64)]
        spots, hashes = spots[hit], hashes[hit]
        seed = np.searchsorted(self.seeds, hashes)
        hit = self.seeds[np.minimum(seed, len(self.seeds) - 1)] == hashes
        spots, seed = spots[hit], seed[hit]
        if not len(spots):
            return []
        own = np.unique(seed)
        size = self.first[own + 1] - self.first[own]
        # the words at which seeds of the text begin in items, each once
        at = np.sort(self.places[np.repeat(self.first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())])
        owner = np.searchsorted(self.cuts, at, "right") - 1
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        reach = np.minimum(np.diff(at, append=at[-1] + least), least)
        reach[np.append(begins[1:], len(at)) - 1] = least
        covered = np.add.reduceat(reach, begins)
        lengths = np.diff(self.cuts)[owner[begins]]
        out, done = [], {}
        ends = np.append(begins[1:], len(at))
        for k in np.flatnonzero(covered >= coverage * lengths).tolist():  # tiles lie within seeds, so others can't cover enough
            o, starts = int(owner[begins[k]]), at[begins[k] : ends[k]] - self.cuts[owner[begins[k]]]
            item = self.words[self.cuts[o] : self.cuts[o + 1]]
            item = _condensed(item, _union(starts, len(item), least))
            if item.tobytes() not in done:
                # Only words within this item's seeds can be tiled; a mark keeps the stretches apart.
                mine = np.isin(self.seeds[seed], Rolling(item).windows(least))
                part = _condensed(ids, _union(spots[mine], len(ids), least))
                done[item.tobytes()] = sum(n for _, _, n in tiles(item, part, least))
            tiled = done[item.tobytes()]
            if tiled >= coverage * lengths[k]:
                out.append((self.names[o], int(lengths[k]), tiled, tiled / int(lengths[k])))
        return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``; an item is never split."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, item_words, tiled_words, coverage of each leak."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, item_words long, tiled_words long, coverage double"

    def task(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows(batches):
                out = [(name, *leak) for name, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True) for leak in index.value.leaks(text, coverage)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

        return run

    found = None
    for items in benchmark_blocks(benchmark, block_bytes):
        part = source.mapInArrow(task(docs.sparkSession.sparkContext.broadcast(Index(items))), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns as they are."""

    def task(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows(batches, by=text_col):
                yield batch.filter(pa.array([not index.value.leaks(t, coverage) for t in texts(batch.column(text_col))], pa.bool_()))

        return run

    for items in benchmark_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(task(docs.sparkSession.sparkContext.broadcast(Index(items))), docs.schema)
    return docs


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
