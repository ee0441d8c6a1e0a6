"""Ranked lexical search: document-sharded postings with integer impacts, scored a term at a time.

``Index`` reads a table twice. First it counts the documents with terms and all their terms. Then each task cuts its
documents into shards of about ``SHARD`` bytes of text and at most 65,536 documents, and writes one row a shard:
sorted 64-bit hashes of the terms, where each term's postings begin (compressed sparse rows), the documents' places
in the shard, and the impact of each posting, an integer that depends on the term's frequency and the document's length
but not on the query. Every document and term is indexed; nothing is shuffled.

A search reads the queries in blocks of a bounded number of terms. The shards' numbers of documents for the block's terms add up to
document frequencies, of which the weights follow. Then each task loads a shard, adds weight times impact of one term after
the other into a dense array with an entry a document, and picks the best by ``argpartition``: all that reach the k-th
score compete, so ties go by id. A task keeps the best k of each query over its shards; the best of all tasks are merged by a window
that Spark limits to k rows a query and task before they are shuffled. So a hot term, a long list of postings, is spread over all shards.

Null and empty texts, and texts without terms, are in no shard and are never found; a query without terms finds nothing. Repeated
rows are documents of their own, and queries of their own. Documents with a null id are found and ranked before other
ids of the same score (the smallest 64-bit integer stands for null). A very long text is a shard by itself, which a task holds in
memory. Empty tables give empty results. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, rows
from .textbytes import TERM, word_counts, word_hashes

#: Bytes of text and documents of a shard; terms of a block of queries, each query counting for OWN more; results.
SHARD, PLACES, BLOCK, OWN, TOP = 8 << 20, 1 << 16, 1 << 20, 64, 10
NO_ID = np.iinfo(np.int64).min


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Impact of terms that occur ``tf`` times in documents of so many terms, among all ``documents`` with ``terms`` in sum."""
    wide = int(lengths.max(initial=0)) * 75 * documents >= 1 << 63
    m = 25 + (75 * documents * (lengths.astype(object) if wide else lengths.astype(np.int64)) // terms).astype(np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.uint32)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID), np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in rows(batches):
        n = word_counts(batch.column("text"), TERM)
        documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


SHARDS = "ids binary, terms binary, starts binary, places binary, impacts binary"
NAMES = [c.split()[0] for c in SHARDS.split(", ")]


def shard_row(ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> list[bytes]:
    """Compressed sparse rows of a shard's terms; ``hashes`` are those of one document after the other."""
    order = np.argsort(hashes, kind="stable")  # places ascend within a term
    of, place = hashes[order], np.repeat(np.arange(len(ids), dtype=np.uint16), lengths)[order]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1])])
    tf = np.diff(np.r_[first, len(of)])
    of, place = of[first], place[first]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return [x.tobytes() for x in (ids, of[starts], np.r_[starts, len(of)].astype(np.uint32), place, impacts(tf, lengths[place], documents, terms))]


def _shards(documents: int, terms: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = long = 0

        def batch_of() -> pa.RecordBatch:
            row = shard_row(*(np.concatenate(x) for x in zip(*held, strict=True)), documents, terms)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], NAMES)

        for batch in rows(batches, most=min(size, 1 << 20)):
            hashes, cuts = word_hashes(batch.column("text"), TERM)
            lengths = np.diff(cuts)
            if not len(hashes):
                continue
            if held and (count + (lengths > 0).sum() > PLACES or long + batch.column("text").nbytes > size):
                yield batch_of()
                held, count, long = [], 0, 0
            held.append((_ids(batch.column("doc_id"))[lengths > 0], hashes, lengths[lengths > 0]))
            count, long = count + len(held[-1][0]), long + batch.column("text").nbytes
        if held:
            yield batch_of()

    return run


ITEMS = "uid long, item_id long, terms binary, counts binary, n long"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 36
    for batch in rows(batches):
        hashes, cuts = word_hashes(batch.column("text"), TERM)
        own = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:], strict=False)]
        columns = [pa.array(range(uid, uid + len(own)), pa.int64()), batch.column("item_id"), pa.array([t.tobytes() for t, _ in own], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in own], pa.binary()), pa.array([len(t) for t, _ in own], pa.int64())]
        uid += len(own)
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ITEMS.split(", ")])


class Block:
    """Queries that are searched together: their distinct terms, and for each query places and numbers of its own."""

    def __init__(self, items: list):
        each = [np.frombuffer(r["terms"], np.uint64) for r in items]
        self.uids, self.item_ids = [r["uid"] for r in items], [r["item_id"] for r in items]
        self.terms = np.unique(np.concatenate(each))
        self.places = [np.searchsorted(self.terms, t) for t in each]
        self.counts = [np.frombuffer(r["counts"], np.int64) for r in items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a shard's terms each term is, and whether it is one of them."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return at, terms[at] == self.terms


def _frequencies(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.value.terms), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                at, hit = block.value.found(np.frombuffer(terms.as_buffer(), np.uint64))
                total += np.diff(np.frombuffer(starts.as_buffer(), np.uint32).astype(np.int64))[at] * hit
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores above 0 and their ids, equal scores by id."""
    least = 1
    if len(scores) > top:
        least = max(1, int(scores[np.argpartition(scores, len(scores) - top)[len(scores) - top :]].min()))
    at = np.flatnonzero(scores >= least)  # with all that tie for the last place
    at = at[np.lexsort((ids[at], -scores[at]))[:top]]
    return scores[at], ids[at]


def _scores(block, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in b.uids]
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(c)[row].as_buffer() for c in NAMES]
                ids, terms, starts, places, worth = (np.frombuffer(x, k) for x, k in zip(raw, (np.int64, np.uint64, np.uint32, np.uint16, np.uint32), strict=True))
                (at, hit), worth, sums = b.found(terms), worth.astype(np.int64), np.zeros(len(ids), np.int64)
                for q, (own, counts) in enumerate(zip(b.places, b.counts, strict=True)):
                    have = hit[own]
                    if not have.any():
                        continue
                    sums[:] = 0
                    for t, n in zip(own[have].tolist(), counts[have].tolist(), strict=True):
                        a, z = starts[at[t]], starts[at[t] + 1]
                        sums[places[a:z]] += worth[a:z] * (n * b.weights[t])
                    more = best(sums, ids, top)
                    held[q] = best(np.concatenate([held[q][0], more[0]]), np.concatenate([held[q][1], more[1]]), top)
        out = [(uid, item, None if i == NO_ID else i, s) for uid, item, (scores, ids) in zip(b.uids, b.item_ids, held, strict=True) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        names = ["uid", "item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names)

    return run


class Index:
    """Shards of the postings of all documents of a table."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD):
        self.spark, self.ws = spark, Workspace(spark, "search")
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        counted = docs.select("text").mapInArrow(_counts, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
        self.documents, self.terms = counted[0] or 0, counted[1] or 0
        # Small row groups, so that a task reads few shards at once.
        made = docs.mapInArrow(_shards(self.documents, self.terms, shard), SHARDS).write.option("parquet.block.size", 2 * shard)
        self.ws.names.append("shards")
        self.path = f"{self.ws.path}/shards"
        made.option("compression", "zstd").parquet(self.path)

    def drop(self) -> None:
        """Remove the postings; results of searches stay."""
        self.ws.drop("shards")

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARDS).parquet(self.path)

    def search(self, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
        """uid (of a row of queries), item_id, rank, doc_id and score of each query's best documents."""
        read = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
        items = self.ws.table("items", read.mapInArrow(_items, ITEMS)).where("n > 0")
        blocks = -(-(items.agg(F.sum(F.col("n") + OWN)).first()[0] or 0) // block)
        found = self.spark.createDataFrame([], "uid long, item_id long, doc_id long, score long")
        for k in range(blocks):
            own = items.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == k).orderBy("uid").collect()  # bounded by ``block`` in the mean
            if own:
                found = found.unionByName(self.ws.table(f"found-{k}", self._block(Block(own), top)))
        by = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("uid", "item_id", "rank", "doc_id", "score")

    def _block(self, block: Block, top: int) -> DataFrame:
        context = self.spark.sparkContext
        sent = context.broadcast(block)
        counted = self.shards().select("terms", "starts").mapInArrow(_frequencies(sent), "term long, df long").groupBy("term").agg(F.sum("df")).collect()
        sent.unpersist()
        for term, df in counted:  # one row a term of the block at most
            block.weights[term] = weight(df, self.documents)
        return self.shards().mapInArrow(_scores(context.broadcast(block), top), "uid long, item_id long, doc_id long, score long")


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = Index(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("uid")
    index.drop()
    return found
