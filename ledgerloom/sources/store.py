"""Stored tables in versions: rows by key, changed by whole new versions that appear at once or not at all.

A table is a folder. ``data/<token>/bucket=<b>`` has the rows of a bucket (a hash of the key) as one write left them;
``versions/<n>.json`` says which write holds each bucket. A change reads and writes the buckets that it touches, in a folder of its own, and then
adds the next version file by a rename that fails if the file is there. So a reader sees the version before or after; a write that
fails, or loses its executors, leaves nothing that a version names; of two writers at once one gets a ``Conflict`` and may try again on the new version.
A change that carries the ``batch`` of an earlier one is taken for a retry and does nothing.

The file system has to rename atomically (HDFS and local disks do). Keys can't be null. Of rows with one key in one change the one with
the greatest ``order`` stays (any, without an order). An empty change makes a version without new data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has added the next version."""


class Files:
    """Small files through Hadoop's file systems, so that any path Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        fs = self.system(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(self.path(folder))) if fs.exists(self.path(folder)) else []

    def text(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, name: str, text: str) -> None:
        """A new file, whole or not at all; raises ``Conflict`` if there is one of that name."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.system(name).create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context, none = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf), self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            context.rename(self.path(draft), self.path(name), options)
        except Exception as e:
            self.system(name).delete(self.path(draft), False)
            if "AlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    def remove(self, folder: str) -> None:
        self.system(folder).delete(self.path(folder), True)


class Store:
    """A table of rows by ``key`` in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets, self.files = spark, folder.rstrip("/"), key, buckets, Files(spark)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else StructType.fromJson(schema.jsonValue())
        for f in self.schema:
            f.nullable = f.name != key

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """A version's buckets; the last one's by default."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": {}, "batches": []}
        return json.loads(self.files.text(f"{self.folder}/versions/{known[-1] if version is None else version:012d}.json"))

    def _rows(self, buckets: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{token}/bucket={b}" for b, token in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["buckets"])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows with their bucket in a new folder: the buckets that have some, and that folder."""
        token = uuid.uuid4().hex
        path = f"{self.folder}/data/{token}"
        rows.repartition(min(self.buckets, 4096), "bucket").write.partitionBy("bucket").parquet(path)
        return {n.removeprefix("bucket="): token for n in self.files.names(path) if n.startswith("bucket=")}

    def _commit(self, before: dict, buckets: dict[str, str], batch: str | None) -> int:
        version = before["version"] + 1
        batches = before["batches"] + [batch] * (batch is not None)
        self.files.add(f"{self.folder}/versions/{version:012d}.json", json.dumps({"version": version, "buckets": buckets, "batches": batches}))
        return version

    def _latest(self, rows: DataFrame, order: str | None) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.col(order) if order else F.lit(0)).alias("row")).select(self.key, "row.*")

    def _touch(self, change: DataFrame, put: bool, batch: str | None) -> int:
        """A version without the old rows of the change's keys, and with the change if it is put. The change is written first, so it is computed once."""
        before = self.manifest()
        if batch is not None and batch in before["batches"]:
            return before["version"]
        new = self._write(change)
        draft = [f"{self.folder}/data/{token}" for token in set(new.values())]
        rows = self._rows(new)
        stored = {b: before["buckets"][b] for b in new if b in before["buckets"]}
        kept = self._rows(stored).join(rows.select(self.key), self.key, "left_anti").select(self.schema.names)
        after = self._write(self._bucketed(kept.unionByName(rows) if put else kept)) if new else {}
        version = self._commit(before, {b: t for b, t in before["buckets"].items() if b not in new} | after, batch)
        for path in draft:
            self.files.remove(path)
        return version

    def upsert(self, rows: DataFrame, order: str | None = None, batch: str | None = None) -> int:
        """Rows of new keys are added, those of known keys replaced; gives the version."""
        return self._touch(self._bucketed(self._latest(rows, order)), True, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        return self._touch(self._bucketed(keys.select(self.key).distinct().select(self.key, *missing)), False, batch)

    def replace(self, rows: DataFrame | None = None, order: str | None = None, batch: str | None = None) -> int:
        """These rows (or none) instead of all others, in one version."""
        before = self.manifest()
        if batch is not None and batch in before["batches"]:
            return before["version"]
        return self._commit(before, self._write(self._bucketed(self._latest(rows, order))) if rows is not None else {}, batch)

    def roll_back(self, version: int) -> int:
        """An older version's rows as the newest version."""
        return self._commit(self.manifest(), self.manifest(version)["buckets"], None)

    def vacuum(self, keep: int = 2) -> int:
        """Removes data that none of the last ``keep`` versions names, also of writes that failed, and older versions; no write may be under way."""
        known = self.versions()
        held = {t for v in known[-keep:] for t in self.manifest(v)["buckets"].values()}
        gone = [t for t in self.files.names(f"{self.folder}/data") if t not in held]
        for token in gone:
            self.files.remove(f"{self.folder}/data/{token}")
        for v in known[:-keep]:
            self.files.remove(f"{self.folder}/versions/{v:012d}.json")
        return len(gone)


def lock(store: Store, edits: DataFrame, fixed: str) -> DataFrame:
    """Edits whose ``fixed`` column is that of the stored row, where there is one; ``blocked`` marks those that would have changed it."""
    old = store.read().select(store.key, F.col(fixed).alias("stored"))
    x = edits.join(old, store.key, "left")
    blocked = F.col("stored").isNotNull() & ~F.col(fixed).eqNullSafe(F.col("stored"))
    return x.withColumn("blocked", blocked).withColumn(fixed, F.coalesce("stored", fixed)).drop("stored")
