"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference counts.

A ``LineIndex`` is a set of tables, sharded by a hash of the line's key:

* postings (key, doc_id): which documents hold a line;
* refs (key, refs, owner): exactly how many documents hold it, and the smallest of them;
* seen: a cuckoo filter a shard over all keys. An inserted batch probes it; only keys that may have been
  seen meet the exact counts, the others are new;
* shared: a cuckoo filter a shard over the keys of two documents or more. Only postings that pass it are
  joined with the exact counts when duplicates are dropped.

``insert`` adds documents, ``delete`` takes them back (counts go down, keys leave the filters, owners are
found anew), ``apply`` gives texts without the lines that a smaller document owns. Filters only ever spare
work: an exact join follows each. Filters are sent to all tasks if they are small (``BROADCAST`` bytes,
checked), else postings meet the filter of their shard, in several tasks if these are many. An index that has grown gets more shards.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased, if that has at least
``LEAST`` code points; keys are held as MD5 digests. Null and empty texts are one empty line. Rows
that share an id are one document. Rows without an id stay whole and don't count. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, join_hot_apart, rows, texts

LEAST, SHARDS, SHARD_KEYS, BROADCAST, SLOTS = 10, 64, 250_000, 16 << 20, 4
#: Rows that meet a filter in one task.
PROBES = 2_000_000
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    line = line.strip(SPACE)
    return hashlib.md5(line.encode("utf-8", "surrogatepass").lower(), usedforsecurity=False).digest() if len(line) >= LEAST else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; whole arrays of keys are put in, found and taken out."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds the keys, with room for some more."""
        buckets = 16
        while buckets * SLOTS * 0.8 < len(keys):
            buckets *= 2
        while True:
            out = cls(buckets)
            if out.add(keys):
                return out
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(prints == 0, np.uint16(1), prints), (keys & np.uint64(self.mask)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995) & self.mask)

    @staticmethod
    def _ranks(at: np.ndarray) -> np.ndarray:
        """Of sorted bucket numbers: which of its bucket each is."""
        n = np.arange(len(at))
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        return n - np.maximum.accumulate(np.where(first, n, 0)) if len(at) else n

    def add(self, keys: np.ndarray, rounds: int = 400) -> bool:
        """Puts all keys in; False if the filter is too full for them."""
        prints, at = self._places(keys)
        tries = np.zeros(len(keys), np.int64)
        for turn in range(rounds):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            prints, at, tries = prints[order], at[order], tries[order]
            free, rank = self.cells[at] == 0, self._ranks(at)
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.cells[at[fits], slot[fits]] = prints[fits]
            prints, at, tries = prints[~fits], at[~fits], tries[~fits] + 1
            # Those that found both buckets full throw out one print a bucket; the others try their other bucket.
            kick = (tries >= 2) & (self._ranks(at) == 0)
            slot = (turn + at[kick]) % SLOTS
            out = self.cells[at[kick], slot]
            self.cells[at[kick], slot] = prints[kick]
            prints[kick], tries[kick] = out, 1
            at = self._other(prints, at)
            empty = prints == 0
            prints, at, tries = prints[~empty], at[~empty], tries[~empty]
        return not len(prints)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._places(keys)
        return (self.cells[at] == prints[:, None]).any(1) | (self.cells[self._other(prints, at)] == prints[:, None]).any(1)

    def remove(self, keys: np.ndarray) -> None:
        """Takes out one print for each key; keys must have been put in."""
        prints, at = self._places(keys)
        for p, a, b in zip(prints.tolist(), at.tolist(), self._other(prints, at).tolist(), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.cells[bucket] == p)
                if len(hit):
                    self.cells[bucket, hit[0]] = 0
                    break


def _hashes(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64 bits of each 16-byte key."""
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8")[::2]


FILTER = "shard int, buckets long, cells binary"


def _row(shard: int, f: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([f.mask + 1], pa.int64()), "cells": pa.array([f.cells.tobytes()], pa.binary())})


def _built(keys: DataFrame) -> DataFrame:
    """The filter of each shard of (shard, key)."""
    return keys.select("shard", "key").groupBy("shard").applyInArrow(lambda t: _row(t["shard"][0].as_py(), CuckooFilter.of(_hashes(t["key"]))), FILTER)


def _loaded(table: pa.Table) -> CuckooFilter | None:
    return CuckooFilter(table["buckets"][0].as_py(), table["cells"][0].as_py()) if table.num_rows else None


def _probe(left: DataFrame, filters: DataFrame, columns: str) -> DataFrame:
    """Rows of ``left`` with ``maybe``: whether their shard's filter may hold their key.

    A shard of more than ``PROBES`` rows, as one line of all documents makes, is dealt to several tasks by its other columns.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    sizes = left.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))  # one row a shard
    dealt = left.join(F.broadcast(sizes), "shard").select(*names, F.pmod(F.xxhash64(*names), "parts").cast("int").alias("part"))
    copies = filters.join(F.broadcast(sizes), "shard").select("shard", "buckets", "cells", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        f = _loaded(b)
        maybe = f.may_have(_hashes(a["key"])) if f and a.num_rows else np.zeros(a.num_rows, bool)
        return a.select(names).append_column("maybe", pa.array(maybe, pa.bool_()))

    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(run, columns + ", maybe boolean")


def _sharded(table: DataFrame, shards: int) -> DataFrame:
    return table.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


def _postings(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            keys, names = [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                own = {k for k in map(line_key, text.split("\n")) if k}
                keys += own
                names += [name] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(names, pa.int64())], ["key", "doc_id"])

    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "key binary, doc_id long")
    return _sharded(found, shards).select("shard", "key", "doc_id")


def _refs(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "key").agg(F.count_distinct("doc_id").alias("refs"), F.min("doc_id").alias("owner"))


REFS = "shard int, key binary, refs long, owner long"


class LineIndex:
    """The tables of an index; every change writes new ones and leaves the old ones as they are."""

    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.id_col, self.text_col = spark, id_col, text_col
        self.ws, self.version, self.shards = Workspace(spark, "lines"), 0, 0
        self.postings = self.refs = self.seen = self.shared = None

    def _named(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text_col).alias("text"))

    def _table(self, name: str, df: DataFrame) -> DataFrame:
        return self.ws.table(f"{name}-{self.version}", df, "snappy")

    def insert(self, docs: DataFrame) -> None:
        """Adds documents whose ids the index doesn't have yet."""
        self.version += 1
        docs = self._named(docs)
        if not self.shards:
            self.shards = SHARDS
        new = self._table("added", _postings(docs, self.shards))
        if self.refs is None:
            while self.shards * SHARD_KEYS < new.count():
                self.shards *= 2
            self.postings = _sharded(new, self.shards)
            self.refs = self._table("refs", _refs(self.postings))
            self.seen = self._table("seen", _built(self.refs))
        else:
            probed = self._table("probed", _probe(_refs(new), self.seen, REFS))
            fresh, again = probed.where(~F.col("maybe")).drop("maybe"), probed.where("maybe").drop("maybe")
            met = self.refs.join(again.select("key", F.col("refs").alias("more"), F.col("owner").alias("other")), "key", "left")
            met = met.select("shard", "key", (F.col("refs") + F.coalesce("more", F.lit(0))).alias("refs"), F.least("owner", "other").alias("owner"))
            wrong = again.join(self.refs.select("key"), "key", "left_anti").select("shard", "key", "refs", "owner")
            added = self._table("new-keys", fresh.unionByName(wrong))
            self.seen = self._table("seen", self._filled(added))
            self.postings = self.postings.unionByName(new)
            self.refs = self._table("refs", met.unionByName(added))
            self._grow()
        self._share()

    def _grow(self) -> None:
        """More shards, and filters built anew from the exact keys, once shards hold twice the keys that they should."""
        keys = self.refs.count()
        if keys <= 2 * self.shards * SHARD_KEYS:
            return
        while self.shards * SHARD_KEYS < keys:
            self.shards *= 2
        self.postings, self.refs = _sharded(self.postings, self.shards), _sharded(self.refs, self.shards)
        self.seen = self._table("grown", _built(self.refs))

    def _filled(self, added: DataFrame) -> DataFrame:
        """The filters with new keys; a filter that is too full is built anew from the exact keys."""

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            shard = (a if a.num_rows else b)["shard"][0].as_py()
            f = _loaded(b)
            if f is None:
                return _row(shard, CuckooFilter.of(_hashes(a["key"])))
            held = int((f.cells > 0).sum())
            full = held + a.num_rows > f.cells.size * 0.9 or a.num_rows and not f.add(_hashes(a["key"]))
            return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([0 if full else f.mask + 1], pa.int64()), "cells": pa.array([b"" if full else f.cells.tobytes()], pa.binary())})

        filled = self._table("filled", added.select("shard", "key").groupBy("shard").cogroup(self.seen.groupBy("shard")).applyInArrow(run, FILTER))
        full = filled.where("buckets = 0").select("shard")
        keys = self.refs.select("shard", "key").unionByName(added.select("shard", "key")).join(full, "shard", "left_semi")
        return filled.where("buckets > 0").unionByName(_built(keys))

    def _share(self) -> None:
        self.shared = self._table("shared", _built(self.refs.where("refs > 1")))

    def delete(self, docs: DataFrame) -> None:
        """Takes documents (their ids) out of the index."""
        self.version += 1
        gone = docs.select(F.col(self.id_col).cast("long").alias("doc_id")).distinct()
        lost = self._table("lost", _refs(self.postings.join(gone, "doc_id", "left_semi")))
        self.postings = self._table("postings", self.postings.join(gone, "doc_id", "left_anti"))
        less = lost.select("key", F.col("refs").alias("less"), F.col("owner").alias("first"))
        met = self._table("met", self.refs.join(less, "key", "left").withColumn("left", F.col("refs") - F.coalesce("less", F.lit(0))))
        dead = met.where("left = 0").select("shard", "key")
        orphan = met.where("left > 0 and owner = first").select("key")
        owners = self.postings.join(orphan, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
        kept = met.where("left > 0").join(owners, "key", "left")
        self.refs = self._table("refs", kept.select("shard", "key", F.col("left").alias("refs"), F.coalesce("heir", "owner").alias("owner")))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            f = _loaded(b)
            if a.num_rows:
                f.remove(_hashes(a["key"]))
            return _row(b["shard"][0].as_py(), f)

        self.seen = self._table("seen", dead.groupBy("shard").cogroup(self.seen.groupBy("shard")).applyInArrow(run, FILTER))
        self._share()

    def _candidates(self) -> DataFrame:
        """Postings whose key the shared filters may hold."""
        size = self.shared.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
        postings = self.postings.select("shard", "key", "doc_id")
        if size > BROADCAST:
            return _probe(postings, self.shared, "shard int, key binary, doc_id long").where("maybe").select("key", "doc_id")
        held = {r["shard"]: (r["buckets"], bytes(r["cells"])) for r in self.shared.collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter(*x) for s, x in held.items()}
            for batch in rows(batches, 20_000):
                shards, hashes = np.asarray(batch.column("shard")), _hashes(batch.column("key"))
                maybe = np.zeros(batch.num_rows, bool)
                for s in np.unique(shards).tolist():
                    if s in filters:
                        at = np.flatnonzero(shards == s)
                        maybe[at] = filters[s].may_have(hashes[at])
                yield batch.select(["key", "doc_id"]).filter(pa.array(maybe))

        return postings.mapInArrow(run, "key binary, doc_id long")

    def drops(self) -> DataFrame:
        """doc_id and the keys of the lines that it loses."""
        exact = self.refs.where("refs > 1").select("key", "owner")
        found = join_hot_apart(self._table("candidates", self._candidates()), exact, "key").where(F.col("owner") < F.col("doc_id"))
        return found.select("key", "doc_id").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, other_columns: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (text) of each row; or the rows with the text replaced."""
        source = docs if other_columns else self._named(docs)
        id_name, text_name = (self.id_col, self.text_col) if other_columns else ("doc_id", "text")
        names = source.columns
        owner, gone_keys = fresh("owner", names), fresh("gone", names)
        keys = self.drops().withColumnsRenamed({"doc_id": owner, "keys": gone_keys})
        joined = source.join(keys, F.col(id_name).cast("long") == F.col(owner), "left").drop(owner)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows(batches, by=text_name):
                kept, counts, dropped = [], [], []
                for text, gone in zip(texts(batch.column(text_name)), batch.column(gone_keys).to_pylist(), strict=True):
                    lines = text.split("\n")
                    left = lines
                    if gone:
                        gone = set(gone)
                        left = [x for x in lines if line_key(x) not in gone]
                    kept.append("\n".join(left))
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(left))
                if other_columns:
                    # a null text stays null
                    old = batch.column(text_name).is_null().to_pylist()
                    new = pa.array([None if o else k for o, k in zip(old, kept, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([new if n == text_name else batch.column(n) for n in names], names)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        if not other_columns:
            return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
        return joined.mapInArrow(run, source.schema)


def op2_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the smallest of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = LineIndex(spark)
    index.insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
