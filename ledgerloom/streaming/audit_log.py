"""Streaming ingest of the audit log: an addition of this engine, the reference model has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.shared import fresh_path


def hourly_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events by hour and type; events later than the delay are late, and an hour's state is dropped once it is behind it."""
    hour = F.window("ts", "1 hour")
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(hour, "event_type").agg(F.count("*").alias("rows"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "rows")


@query("stream_event_counts", "select date_trunc('hour', ts) as hour, event_type, count(*) as rows from events group by 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, until none is left.

    In update mode a batch writes only the counts that it changed, to a folder of its own, so a batch that runs
    again replaces what it wrote; of each key the last batch's count holds.
    """
    out, path = fresh_path(spark, "stream"), f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    stream = hourly_counts(events).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}-state")
    stream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    changes = spark.read.schema("hour timestamp, event_type string, rows long, batch long").parquet(out)
    return changes.groupBy("hour", "event_type").agg(F.max_by("rows", "batch").alias("rows"))


def append_once(log: str) -> Callable[[DataFrame, int], None]:
    """A sink of batches: each has a folder of its own, so a batch that runs again replaces what it wrote and adds nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return put


def append_audit(events: DataFrame, log: str, state: str, delay: str = "1 hour", key: str = "event_id") -> None:
    """Appends a stream's events to a log, until none is left.

    An event that comes again within the delay of its time isn't added: its id is state until the watermark has passed
    it. Events later than the watermark are dropped, as their ids may be forgotten. ``state`` is the stream's checkpoint: a
    stream that starts again goes on where it was.
    """
    fresh = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    fresh.writeStream.foreachBatch(append_once(log)).trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination()


@query("audit_log_append", "select event_id, event_type as type, user_id as entity_id from events")
def audit_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events appended to the log, although each comes twice and the stream is started twice."""
    out, path = fresh_path(spark, "audit"), f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))
        append_audit(source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"), f"{out}/log", f"{out}/state")
    kind = spark.read.schema("event_id long, event_type string, user_id long, batch long").parquet(f"{out}/log")
    return kind.select("event_id", F.col("event_type").alias("type"), F.col("user_id").alias("entity_id"))
