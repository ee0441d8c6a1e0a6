"""Shopping sessions of lists as keyed state of a stream: one open session for each list and market.

The first entry of a list at a market opens a session, a purchase closes it, and the next entry opens another. The state of a
key is the number of its open session, so it doesn't grow with the entries. Entries of a micro-batch are sorted by time and
id; an entry that comes in a later micro-batch belongs to the session that is open then. A stream that starts again goes
on with the state of its checkpoint. Null lists or markets are keys of their own; a stream without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import query
from ..plans.shared import fresh_path
from .audit_log import append_once

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "list_id long, market long, event_id long, session long"


class Sessions(StatefulProcessor):
    """Entries (ts, event_id, closes) of a list at a market to the numbers of their sessions, from 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "number long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        number = self.open.get()[0] if self.open.exists() else 0
        x = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        closes = x["closes"].to_numpy().astype("int64")
        self.open.update((number + int(closes.sum()),))
        yield pd.DataFrame({"key": key[0], "event_id": x["event_id"].to_numpy(), "session": number + closes.cumsum() - closes})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """The session with a state store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def sessions(entries: DataFrame) -> DataFrame:
    """A stream of (list_id, market, event_id, session) of a stream of (list_id, market, ts, event_id, closes)."""
    # One text is the key: a null number among the keys of an Arrow batch would turn the others into floats, which the state doesn't know.
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    keyed = entries.select(F.concat_ws("|", part("list_id"), part("market")).alias("key"), "ts", "event_id", "closes")
    x = keyed.groupBy("key").transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType="key string, event_id long, session long", outputMode="Append", timeMode="None")
    said = lambda i: F.nullif(F.split("key", "[|]")[i], F.lit("-")).cast("long")
    return x.select(said(0).alias("list_id"), said(1).alias("market"), "event_id", "session")


def run(entries: DataFrame, out: str, state: str) -> None:
    """Appends the sessions of all entries that are there by now, until none is left."""
    with rocks(entries.sparkSession):
        sessions(entries).writeStream.outputMode("append").foreachBatch(append_once(out)).trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination()


MARKET = "cast(get_json_object(props, '$.k') as bigint) % 3"


@query("list_sessions_stream", "with e as (select user_id as list_id, cast(props ->> '$.k' as bigint) % 3 as market, event_id, ts, (event_type = 'purchase')::int as closes from events), s as (select *, coalesce(sum(closes) over (partition by list_id, market order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as session from e) select list_id, market, session, count(*) as entries, min(event_id) as first_id, max(event_id) as last_id from s group by 1, 2, 3")
def list_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all events that arrive in three parts, after each of which the stream stops and starts again."""
    base = fresh_path(spark, "sessions")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select(F.col("user_id").alias("list_id"), F.expr(MARKET).alias("market"), "ts", "event_id", (F.col("event_type") == "purchase").alias("closes"))
    early, late = e.agg(F.percentile_approx("ts", [1 / 3, 2 / 3])).first()[0]
    for part, rows in enumerate((e.where(F.col("ts") <= early), e.where((F.col("ts") > early) & (F.col("ts") <= late)), e.where(F.col("ts") > late))):
        rows.write.parquet(f"{base}/in/{part}")
        run(spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in"), f"{base}/out", f"{base}/state")
    x = spark.read.schema(ENTRY).parquet(f"{base}/out")
    return x.groupBy("list_id", "market", "session").agg(F.count("*").alias("entries"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
