"""Versions of stored tables: upserts, retries, failures, conflicts, resets."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.store import Conflict, Store, lock

SCHEMA = "id long, name string, at long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/t", SCHEMA, "id", 8)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(store, version=None):
    return {r["id"]: r["name"] for r in store.read(version).collect()}


def test_upserts_replace_only_touched_buckets(spark, store):
    assert held(store) == {} and store.versions() == []
    store.upsert(frame(spark, *((i, f"n{i}", 0) for i in range(100))))
    first = store.manifest()["buckets"]
    store.upsert(frame(spark, (3, "new", 1), (3, "newer", 2), (500, "more", 1), (500, "old", 0)), "at")
    assert held(store) == {i: f"n{i}" for i in range(100)} | {3: "newer", 500: "more"}
    changed = {b for b, t in store.manifest()["buckets"].items() if first.get(b) != t}
    assert 1 <= len(changed) <= 2
    assert held(store, 1) == {i: f"n{i}" for i in range(100)}


def test_a_retried_batch_does_nothing(spark, store):
    store.upsert(frame(spark, (1, "a", 0)), batch="b1")
    store.upsert(frame(spark, (1, "b", 0)), batch="b2")
    assert store.upsert(frame(spark, (1, "a", 0)), batch="b1") == 2
    assert store.replace(frame(spark), batch="b2") == 2
    assert held(store) == {1: "b"} and store.versions() == [1, 2]


def test_a_failed_write_leaves_the_version_before(spark, store):
    store.upsert(frame(spark, (1, "a", 0)))
    bad = frame(spark, (1, "x", 0), (2, "y", 0)).withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    for change in (store.upsert, store.replace):
        with pytest.raises(Exception, match="lost"):
            change(bad)
    assert held(store) == {1: "a"} and store.versions() == [1]
    store.vacuum()
    assert held(store) == {1: "a"}


def test_the_second_of_two_writers_is_told(spark, store):
    store.upsert(frame(spark, (1, "a", 0)))
    before = store.manifest()
    store.upsert(frame(spark, (2, "b", 0)))
    with pytest.raises(Conflict):
        store._commit(before, {}, None)
    assert held(store) == {1: "a", 2: "b"}
    assert not [n for n in store.files.names(f"{store.folder}/versions") if "draft" in n]


def test_delete_reset_roll_back_and_vacuum(spark, store):
    store.upsert(frame(spark, *((i, str(i), 0) for i in range(20))))
    store.delete(frame(spark, (4, None, None), (4, None, None), (99, None, None)))
    assert sorted(held(store)) == [i for i in range(20) if i != 4]
    store.replace()
    assert held(store) == {}
    store.upsert(frame(spark))
    assert store.versions() == [1, 2, 3, 4] and held(store) == {}
    store.roll_back(2)
    assert len(held(store)) == 19
    store.vacuum(1)
    assert store.versions() == [5] and len(held(store)) == 19


def test_locked_columns_keep_what_is_stored(spark, store):
    store.upsert(frame(spark, (1, "a", 0), (2, None, 0)))
    got = {r["id"]: (r["name"], r["blocked"]) for r in lock(store, frame(spark, (1, "b", 1), (2, "c", 1), (3, "d", 1)), "name").collect()}
    assert got == {1: ("a", True), 2: ("c", False), 3: ("d", False)}
