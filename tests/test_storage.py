"""As-of joins, restores and the audit log on odd rows."""

import datetime as dt

import pytest

from ledgerloom.operators import storage
from ledgerloom.sources import backup
from ledgerloom.sources.store import Store
from ledgerloom.streaming.audit_log import append_audit, append_once


def day(n):
    return dt.date(2020, 1, n)


def test_as_of_takes_the_row_that_held_on_the_day(spark):
    edits = spark.createDataFrame([("a", day(5), "x"), ("a", day(9), "y"), ("a", day(9), "w"), ("b", day(1), None)], "k string, since date, sector string")
    history = storage.valid_ranges(edits, "k", "since")
    facts = spark.createDataFrame([(1, "a", day(4)), (2, "a", day(5)), (3, "a", day(8)), (4, "a", day(9)), (5, "b", day(2)), (6, "c", day(2)), (7, "a", None), (8, None, day(9)), (8, None, day(9))], "id int, k string, day date")
    got = sorted((r["id"], r["sector"], r["since"], r["until"]) for r in storage.as_of(facts, history, "k", "day").collect())
    none = (None, None, None)
    assert got == [(1, *none), (2, "x", day(5), day(9)), (3, "x", day(5), day(9)), (4, "y", day(9), None), (5, None, day(1), None), (6, *none), (7, *none), (8, *none), (8, *none)]
    assert storage.as_of(facts.limit(0), history, "k", "day").collect() == []
    assert storage.as_of(facts, history.limit(0), "k", "day").count() == 9


def test_a_restore_of_no_backup_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "id long, name string", "id")
    store.upsert(spark.createDataFrame([(1, "a")], "id long, name string"))
    spark.createDataFrame([("other", 1, "s", "{}")], "format string, schema_version int, name string, schema string").write.json(f"{tmp_path}/b/manifest")
    with pytest.raises(ValueError, match="is no"):
        storage.restore({"s": store}, f"{tmp_path}/b")
    assert store.versions() == [1]
    backup.export_backup({"s": store.read()}, f"{tmp_path}/c")
    store.replace()
    storage.restore({"s": store}, f"{tmp_path}/c")
    assert [tuple(r) for r in store.read().collect()] == [(1, "a")]


def test_replayed_and_repeated_events_are_logged_once(spark, tmp_path):
    kind, log = "event_id long, ts timestamp, type string", f"{tmp_path}/log"
    at = lambda m: dt.datetime(2026, 1, 1, 10, m)
    for n, rows in enumerate([[(1, at(0), "a"), (2, at(1), "b"), (1, at(0), "a")], [(2, at(1), "b"), (3, at(5), "c")], [(4, at(6), "d"), (3, at(5), "c")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        append_audit(source, log, f"{tmp_path}/state")
    assert sorted(r[0] for r in spark.read.schema(kind).parquet(log).collect()) == [1, 2, 3, 4]
    batch = spark.createDataFrame([(9, at(9), "z")], kind)
    for _ in range(2):
        append_once(log)(batch, 77)
    assert sorted(r[0] for r in spark.read.schema(kind).parquet(log).collect()) == [1, 2, 3, 4, 9]
