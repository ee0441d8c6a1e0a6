"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints.

Lengths come from the global counts of ids by package-merge, at most ``LIMIT`` bits; codes are
canonical, so a file set stores only one length for each id. A file is a Parquet table of blocks
in ascending document order: whole documents up to about ``BLOCK`` ids (a longer document has a
block of its own), the ids' code bits, and the bit offset of every ``EVERY``-th id. A block is
decoded alone: all its checkpoints (of several blocks, if given) advance together, each step one lookup
of ``LIMIT`` bits in a table of id and length.

Null texts count as empty: such a document has just the end id. Rows with equal ids stay rows of their
own, in order of their ids' bytes; null ids come first. An empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions, rows
from .tokens import encoder, id_type, with_end, word_vocabulary

LIMIT, BLOCK, EVERY = 18, 1 << 16, 512
END_ID = 1


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    ids = ids[np.argsort(counts[ids], kind="stable")]
    n, w = len(ids), counts[ids].astype(np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    if n < 2:
        lengths[ids] = 1
        return lengths
    levels, merged = [np.ones(n, bool)], w
    for _ in range(limit - 1):
        both = np.concatenate([w, merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(order < n)
    took, own = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:took].sum())
        own[:leaves] += 1
        took = 2 * (took - leaves)
    lengths[ids] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64) if len(order) else spans
    codes[order] = (first >> (np.uint64(32) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``limit`` bits."""
    symbols, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    used = int(spans.sum())
    symbols[:used] = np.repeat(order, spans)
    sizes[:used] = np.repeat(lengths[order], spans)
    return symbols, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, and the bit offset of every EVERY-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(ends[-1]) // 64 + 2 if len(ids) else 0, np.uint64)
    if len(ids):
        high = codes[ids].astype(np.uint64) << (np.uint64(64) - size.astype(np.uint64))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.add.reduceat(high >> bit, starts)
        over = np.flatnonzero((at & 63) + size > 64)
        out[word[over] + 1] += high[over] << (np.uint64(64) - bit[over])
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], at[::EVERY].astype(np.int64)


def decode_blocks(payloads: list[bytes], checks: list[np.ndarray], counts: list[int], table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    """The ids of each block; all checkpoints of all blocks advance together."""
    symbols, sizes = table
    data = np.frombuffer(b"".join(payloads) + bytes(EVERY * limit // 8 + 8), np.uint8)
    window = data[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        window = window << np.uint32(8) | data[i : len(data) - 3 + i]
    bases = np.cumsum([0, *(len(p) * 8 for p in payloads)])
    at = np.concatenate([np.asarray(c, np.int64) + b for c, b in zip(checks, bases, strict=False)]) if checks else np.zeros(0, np.int64)
    steps = min(EVERY, max(counts, default=0))
    out = np.empty((steps, len(at)), np.uint32)
    for s in range(steps):
        bits = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[s] = symbols[bits]
        at += sizes[bits]
    lanes = np.cumsum([0, *(len(c) for c in checks)])
    return [out[:, a:b].T.reshape(-1)[:n] if n > steps else out[:n, a:b].T.reshape(-1)[:n] for a, b, n in zip(lanes, lanes[1:], counts, strict=False)]


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, and the ids of the whole text with the end id as bytes of the vocabulary's ``id_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in rows(batches):
            ids, cuts = with_end(*ids_of.encode(batch.column("text")), end_id)
            places = pa.py_buffer((cuts * ids.dtype.itemsize).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, places, pa.py_buffer(ids.tobytes())])], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int, dtype: str = "<u2") -> np.ndarray:
    """Global counts by id: summed in each task, then by id; the driver gets one row an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in rows(batches, by="ids"):
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


BLOCKS = "task int, first long, n_ids int, doc_ids array<long>, doc_sizes array<long>, checkpoints array<long>, payload binary"


def write_ids(ws: Workspace, tokens: DataFrame, vocabulary: int, dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """The blocks in ascending document order, and the code (one row), as written tables."""
    lengths = code_lengths(id_counts(tokens, vocabulary, dtype))
    code = ws.table("code", ws.spark.createDataFrame([(LIMIT, bytearray(lengths.tobytes()))], "longest int, lengths binary"))
    packed = zlib.compress(lengths.tobytes())  # a byte for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.frombuffer(zlib.decompress(packed), np.uint8)
        codes, task, first, ids, names = canonical_codes(sizes), TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            nonlocal first, ids, names
            every = np.frombuffer(b"".join(ids), dtype)
            payload, checks = encode_block(every, codes, sizes)
            width = np.dtype(dtype).itemsize
            out = [[task], [first], [len(every)], [names], [[len(x) // width for x in ids]], [checks], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            first, ids, names = first + len(every), [], []
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        held = 0
        for batch in rows(batches, by="ids"):
            for name, doc in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                size = len(doc) // np.dtype(dtype).itemsize
                if ids and held + size > BLOCK:
                    yield block()
                    held = 0
                ids.append(doc)
                names.append(name)
                held += size
        if ids:
            yield block()

    ordered = tokens.repartitionByRange(partitions(ws.spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return ws.table("blocks", ordered.mapInArrow(run, BLOCKS), "uncompressed"), code


def read_ids(blocks: DataFrame, code: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as 32-bit integers) of each document, from the files."""
    spark = blocks.sparkSession
    head = code.first()
    lengths, limit = bytes(head["lengths"]), head["longest"]
    packed = zlib.compress(lengths)
    # rows: the tasks that wrote; their ids before
    totals = sorted((r["task"], r["n"]) for r in blocks.groupBy("task").agg(F.sum(F.col("n_ids").cast("long")).alias("n")).collect())
    starts, at = [], 0
    for task, n in totals:
        starts.append((task, at))
        at += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(np.frombuffer(zlib.decompress(packed), np.uint8), limit)
        for batch in rows(batches, 16):
            x = batch.to_pydict()
            out = []
            for names, sizes, first, ids in zip(x["doc_ids"], x["doc_sizes"], x["first"], decode_blocks(x["payload"], x["checkpoints"], x["n_ids"], table, limit), strict=True):
                data, pos = ids.astype("<u4").tobytes(), 0
                for name, size in zip(names, sizes, strict=True):
                    own = data[pos * 4 : (pos + size) * 4]
                    out.append((name, first + pos, size, zlib.crc32(own), own))
                    pos += size
            kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    placed = blocks.join(F.broadcast(spark.createDataFrame(starts, "task int, before long")), "task")
    placed = placed.withColumn("first", F.col("first") + F.col("before")).select("doc_ids", "doc_sizes", "first", "n_ids", "checkpoints", "payload")
    return placed.mapInArrow(run, schema)


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, written as Huffman blocks and read back."""
    from tokenizers import Tokenizer

    path, ws = word_vocabulary(), Workspace(spark, "token-ids")
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    dtype = id_type(vocabulary)
    tokens = ws.table("tokens", token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), path))
    blocks, code = write_ids(ws, tokens, vocabulary, dtype)
    ws.drop("tokens")
    return read_ids(blocks, code)
