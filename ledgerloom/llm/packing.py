"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A document is cut into pieces of ``capacity`` tokens only where it is longer; full pieces are sequences
of their own. The others are dealt at random to cells of about ``CELL`` pieces. For each cell several
islands evolve a population of packings: the crossover injects whole well-filled bins of one parent
into the other, removes the bins that hold a piece twice, exchanges displaced pieces for shorter ones
where that fills a bin better, and puts the rest back by best fit, longest first. Between epochs each island's elite migrates to the next. A cell stops early when its
bins are as few as its tokens allow. The worst-filled bins of 64 cells then form a new cell, and so on until
one cell is left, so no more than a few bins of the whole are badly filled.

Null and empty texts are one piece with just the end id. Pieces of repeated rows are told apart by a
row number. Ties go by that number. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, rows
from .tokens import encoder, with_end, word_vocabulary

CAPACITY, CELL, ISLANDS, POPULATION, GENERATIONS, EPOCHS, WORST, FAN = 4096, 2048, 2, 6, 24, 2, 4, 64

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], bins: Bins, capacity: int) -> Bins:
    """Puts ``items``, longest first, each into the open bin with the least room that holds it."""
    room = sorted((capacity - sum(sizes[i] for i in b)) << 32 | k for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, sizes[i] << 32)
        if at < len(room):
            left = room.pop(at)
            k = left & 0xFFFFFFFF
            bins[k].append(i)
            left -= sizes[i] << 32
        else:
            k = len(bins)
            bins.append([i])
            left = (capacity - sizes[i]) << 32 | k
        insort(room, left)
    return bins


def exchange(loose: list[int], sizes: list[int], bins: Bins, capacity: int) -> list[int]:
    """Swaps one or two pieces of a bin for a longer loose one that fits; gives what is loose then.

    Pairs are tried in bins of up to 8 pieces, single pieces in all bins.
    """
    pool = sorted((sizes[i], i) for i in loose)
    for b in bins:
        if not pool:
            break
        room = capacity - sum(sizes[i] for i in b)
        if not room:
            continue
        outs = [(i,) for i in b] + ([(i, j) for k, i in enumerate(b) for j in b[k + 1 :]] if len(b) <= 8 else [])
        best = None
        for out in outs:
            gone = sum(sizes[i] for i in out)
            at = bisect_left(pool, (room + gone + 1, -1)) - 1
            if at >= 0 and pool[at][0] > gone and (best is None or pool[at][0] - gone > best[0]):
                best = (pool[at][0] - gone, at, out)
        if best:
            new = pool.pop(best[1])[1]
            b[:] = [i for i in b if i not in best[2]] + [new]
            for i in best[2]:
                insort(pool, (sizes[i], i))
    return [i for _, i in pool]


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Fewer and more unevenly filled bins are better."""
    return -len(bins) + sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """``a`` with some of the fullest bins of ``b``, without doubles, displaced pieces put back."""
    full = sorted(range(len(b)), key=lambda k: (-sum(sizes[i] for i in b[k]), k))
    full = full[: max(1, len(full) // 2)]
    chosen = [b[k] for k in rng.choice(full, size=rng.integers(1, max(2, len(full) // 4 + 1)), replace=False)]
    taken = {i for c in chosen for i in c}
    kept, displaced = [list(c) for c in chosen], []
    for c in a:
        if taken.isdisjoint(c):
            kept.append(list(c))
        else:
            displaced += [i for i in c if i not in taken]
    return best_fit(exchange(displaced, sizes, kept, capacity), sizes, kept, capacity)


def mutation(a: Bins, sizes: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Empties the worst-filled bin and a few others, and packs their pieces anew."""
    worst = min(range(len(a)), key=lambda k: (sum(sizes[i] for i in a[k]), k))
    out = {worst, *rng.integers(0, len(a), size=3).tolist()}
    loose = [i for k in out for i in a[k]]
    kept = [list(c) for k, c in enumerate(a) if k not in out]
    return best_fit(exchange(loose, sizes, kept, capacity), sizes, kept, capacity)


def evolve(sizes: list[int], capacity: int, population: list[Bins], rng: np.random.Generator, generations: int = GENERATIONS) -> list[Bins]:
    """The population after some generations, the best first."""
    least = -(-sum(sizes) // capacity)
    score = lambda b: -fitness(b, sizes, capacity)
    if not population:
        population = [best_fit(list(range(len(sizes))), sizes, [], capacity)]
        while len(population[0]) > least and len(population) < POPULATION:
            population.append(mutation(population[int(rng.integers(len(population)))], sizes, capacity, rng))
    population = sorted(population, key=score)[:POPULATION]
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        i, j = rng.integers(0, len(population), size=2)
        children = [crossover(population[min(i, j)], population[max(i, j)], sizes, capacity, rng), mutation(population[0], sizes, capacity, rng)]
        population = sorted(population + children, key=score)[:POPULATION]
    return population


def _numbers(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(numbers: bytes) -> Bins:
    out: Bins = []
    for i, k in enumerate(np.frombuffer(numbers, "<i4").tolist()):
        while len(out) <= k:
            out.append([])
        out[k].append(i)
    return [b for b in out if b]


STATE = "cell long, island int, uids array<long>, sizes array<int>, score double, population array<binary>"


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 8):
            x, out = batch.to_pydict(), []
            for k in range(batch.num_rows):
                sizes = x["sizes"][k]
                rng = np.random.default_rng([x["cell"][k] % (1 << 62), x["island"][k], epoch, len(sizes)])
                found = evolve(sizes, capacity, [_bins(p) for p in x["population"][k]], rng)
                out.append((fitness(found[0], sizes, capacity), [_numbers(p, len(sizes)) for p in found]))
            columns = [batch.column(c) for c in ("cell", "island", "uids", "sizes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.binary()))], [c.split()[0] for c in STATE.split(", ")])

    return run


def _solve(ws: Workspace, level: int, pieces: DataFrame, capacity: int) -> DataFrame:
    """The best packing of each cell of (cell, uid, length): cell, uids, sizes, numbers."""
    gathered = pieces.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("p"))
    state = gathered.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("p.uid").alias("uids"), F.col("p.length").alias("sizes"), F.lit(0.0).alias("score"), F.array().cast("array<binary>").alias("population"))
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["cell", "island"]).withColumn("population", F.array_insert("population", 1, F.col("elite"))).select(*[c.split()[0] for c in STATE.split(", ")])
        state = ws.table(f"level-{level}-epoch-{epoch}", state.mapInArrow(_epoch(capacity, epoch), STATE))
    best = state.groupBy("cell").agg(F.max_by(F.struct("uids", "sizes", F.col("population")[0].alias("numbers")), F.struct("score", -F.col("island"))).alias("b"))
    return best.select("cell", "b.uids", "b.sizes", "b.numbers")


PLACED = "cell long, uid long, length int, bin int, offset int, worst boolean"


def _placed(capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 8):
            x, out = batch.to_pydict(), []
            for cell, uids, sizes, numbers in zip(x["cell"], x["uids"], x["sizes"], x["numbers"], strict=True):
                bins = _bins(numbers)
                fills = [sum(sizes[i] for i in b) for b in bins]
                worst = set() if last else {k for k in sorted(range(len(bins)), key=lambda k: fills[k])[:WORST] if fills[k] < capacity}
                for k, b in enumerate(bins):
                    at = 0
                    for i in b:
                        out.append((cell, uids[i], sizes[i], k, at, k in worst))
                        at += sizes[i]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PLACED.split(", ")])

    return run


def pack(ws: Workspace, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """uid, sequence_id and offset of each piece of (uid, length), lengths from 1 to ``capacity``."""
    alone = pieces.where(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    cells = max(1, -(-rest.count() // CELL))
    todo, done, level = rest.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells))), [alone], 0
    while True:
        last = cells == 1
        placed = ws.table(f"level-{level}", _solve(ws, level, todo, capacity).mapInArrow(_placed(capacity, last), PLACED))
        for epoch in range(EPOCHS):
            ws.drop(f"level-{level}-epoch-{epoch}")
        number = F.lit(level << 56) + F.shiftleft("cell", 16) + F.col("bin")
        done.append(placed.where(~F.col("worst")).select("uid", number.alias("sequence_id"), "offset"))
        if last:
            break
        cells, level = -(-cells // FAN), level + 1
        todo = placed.where("worst").select("uid", "length", F.expr(f"cell div {FAN}").alias("cell"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 (and ids as 32-bit integers) of each piece."""
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, uid = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in rows(batches):
            out = []
            every, cuts = with_end(*ids_of.encode(batch.column("text")), end_id)
            data, cuts = every.astype("<u4").tobytes(), (4 * cuts).tolist()
            for name, a, b in zip(batch.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                ids = data[a:b]
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((uid, name, piece, at // 4, len(own) // 4, zlib.crc32(own), own))
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    schema = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence and the offset in it."""
    ws = Workspace(spark, "packing")
    pieces = ws.table("pieces", cut_pieces(docs, tokenizer, capacity, with_ids=with_ids))
    placed = pack(ws, pieces, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset")]
    return pieces.join(placed, "uid").select(*columns, *["ids"] * with_ids)


def op6_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
