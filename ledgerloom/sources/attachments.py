"""Attachments: files by the digest of their content, and a table of who has them.

``put`` writes each content once, as ``blobs/<first two digits>/<sha256>``, to a draft that is then renamed, so a reader never sees a part
and a task that runs again leaves the same file. The references (id, owner, name, type, size, digest) are a versioned ``Store``, committed after
the files: a reference always has its content. ``contents`` reads the files with Spark's ``binaryFile`` source and checks their digests.

Equal contents are one file, whatever their ids. Of rows with one id in a call one stays, and it replaces an earlier one of that id.
Null and empty contents are the empty file. An empty table adds nothing. Files are written through Arrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store
from .workbooks import opened

REFERENCES = "id long, owner_id long, name string, type string, size long, digest string"


class Attachments:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.references = Store(spark, f"{self.folder}/references", REFERENCES, "id")

    def put(self, files: DataFrame, batch: str | None = None) -> int:
        """Stores rows of (id, owner_id, name, type, content); gives the version of the references."""
        x = files.withColumn("content", F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")))
        x = x.withColumn("digest", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))
        one = x.groupBy("digest").agg(F.min("id").alias("id"))  # of each content one row goes to the writers
        rows = x.join(one, ["digest", "id"], "left_semi").dropDuplicates(["digest"]).select("digest", "content")
        rows.mapInArrow(_writer(f"{self.folder}/blobs"), "digest string").write.format("noop").mode("overwrite").save()
        return self.references.upsert(x.select("id", "owner_id", "name", "type", "size", "digest"), batch=batch)

    def contents(self) -> DataFrame:
        """digest and content of all files but the empty one, which Spark passes over; one whose content isn't that of its name is an error."""
        x = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9a-f]*").load(f"{self.folder}/blobs")
        x = x.select(F.element_at(F.split("path", "/"), -1).alias("digest"), "content").where(F.length("digest") == 64)
        damaged = F.raise_error(F.concat(F.lit("damaged attachment "), "digest"))
        return x.withColumn("content", F.when(F.sha2("content", 256) == F.col("digest"), F.col("content")).otherwise(damaged.cast("binary")))

    def get(self, ids: DataFrame | None = None) -> DataFrame:
        """References (of some ids) with their content."""
        found = self.references.read()
        if ids is not None:
            found = found.join(ids.select("id").distinct(), "id", "left_semi")
        missing = F.raise_error(F.concat(F.lit("no file of attachment "), "digest")).cast("binary")
        content = F.when(F.col("size") == 0, F.lit("").cast("binary")).when(F.col("content").isNull(), missing).otherwise(F.col("content"))
        return found.join(self.contents(), "digest", "left").withColumn("content", content)


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = opened(path)
        for batch in batches:
            for digest, content in zip(batch.column("digest").to_pylist(), batch.column("content"), strict=True):
                end = f"{root}/{digest[:2]}/{digest}"
                if system.get_file_info(end).type == fs.FileType.File:
                    continue  # files appear whole
                system.create_dir(f"{root}/{digest[:2]}", recursive=True)
                draft = f"{root}/{digest[:2]}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as stream:
                    stream.write(content.as_buffer())
                system.move(draft, end)
            yield pa.RecordBatch.from_arrays([batch.column("digest")], ["digest"])

    return run
