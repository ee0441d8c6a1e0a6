"""Sessions over several runs of the stream."""

import datetime as dt

from ledgerloom.streaming import sessions

KIND = "list_id long, market long, ts timestamp, event_id long, closes boolean"


def at(minute):
    return dt.datetime(2026, 1, 1, 10, minute)


def test_sessions_go_on_where_the_stream_stopped(spark, tmp_path):
    parts = [
        [(1, 1, at(2), 12, True), (1, 1, at(1), 11, False), (1, 2, at(1), 13, False), (None, 1, at(1), 14, True)],
        [(1, 1, at(3), 15, False), (1, 2, at(4), 16, True), (None, 1, at(5), 17, False)],
        [],
        [(1, 1, at(6), 19, True), (1, 1, at(6), 18, True), (1, 2, at(7), 20, False), (2, None, at(7), 21, False)],
    ]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/in/{n}")
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            sessions.run(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["event_id"]: (r["list_id"], r["market"], r["session"]) for r in spark.read.schema(sessions.ENTRY).parquet(f"{tmp_path}/out").collect()}
    assert got == {11: (1, 1, 0), 12: (1, 1, 0), 13: (1, 2, 0), 14: (None, 1, 0), 15: (1, 1, 1), 16: (1, 2, 0), 17: (None, 1, 1), 18: (1, 1, 1), 19: (1, 1, 2), 20: (1, 2, 1), 21: (2, None, 0)}
