"""Shared helpers: workspace tables in the shared folder, and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import fresh_path


class Workspace:
    """A folder of written tables that one operator run uses instead of lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path, self.names = fresh_path(spark, name), []

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as a Parquet table and read it again: lineage ends here."""
        path = f"{self.path}/{name}"
        self.names.append(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, *names: str) -> None:
        """Remove all other tables."""
        for name in set(self.names) - {*names}:
            self.drop(name)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more, through Hadoop's file system."""
        self.names.remove(name)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(batches: Iterator[pa.RecordBatch], step: int = 512, by: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``step`` rows, and of ``most`` bytes in column ``by`` or one row, so what one batch needs stays bounded."""
    for batch in batches:
        at, ends = 0, None
        if by in batch.schema.names:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(by)), 0)), dtype=np.int64)
        while at < batch.num_rows:
            to = at + step
            if ends is not None:
                held = ends[at - 1] if at else 0
                to = min(to, max(at + 1, int(np.searchsorted(ends, held + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(ws: Workspace, df: DataFrame, key: str, order: list[str], table: str, name: str) -> DataFrame:
    """``df`` with numbers from 0 within each key (never null), in order; no task gets more of a key than of others.

    Rows are dealt by ranges of (key, order) and numbered within their range; each range's first number
    is the sum of the key's counts in the ranges before. Equal rows are numbered in any order.
    """
    task, before, local = (fresh(c, df.columns) for c in ("task", "before", "local"))
    dealt = ws.table(table, df.repartitionByRange(partitions(ws.spark), key, *order).withColumn(task, F.spark_partition_id()))
    counts = dealt.groupBy(key, task).agg(F.count("*").alias(before))  # a row for each key and range that have rows: keys + ranges at most
    earlier = Window.partitionBy(key).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    counts = ws.table(f"{table}-counts", counts)
    here = dealt.withColumn(local, F.row_number().over(Window.partitionBy(key, task).orderBy(*order)))
    return here.join(counts, [key, task]).withColumn(name, (F.col(before) + F.col(local) - 1).cast("long")).select(*df.columns, name)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def join_hot_apart(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join on one key, unique in ``right``; hot keys don't meet in one task.

    Keys that hold at least 1/``share`` of the rows of ``left`` (so ``share`` keys at most) are joined
    by broadcast of their few rows of ``right``, the others by a shuffle. Null keys match nothing.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("count") * share >= total).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot) | F.col(key).isNull()
    few = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, "left")
    return few.unionByName(left.where(~is_hot).join(right, key, "left"))


def without_keys(table: DataFrame, keys: DataFrame, key: str, few: int = 500_000) -> DataFrame:
    """Rows of ``table`` whose key isn't in ``keys``; null keys stay.

    The keys go to all tasks if they are counted to be ``few`` at most; else both sides are shuffled.
    """
    keys = keys.select(key).distinct()
    return table.join(F.broadcast(keys) if keys.count() <= few else keys, key, "left_anti").select(table.columns)
