"""Attachments by digest, and lists in the order of a collation."""

from pathlib import Path

import pytest

from ledgerloom.operators.ordering import placed
from ledgerloom.sources.attachments import Attachments

KIND = "id long, owner_id long, name string, type string, content binary"


def test_equal_contents_are_one_file(spark, tmp_path):
    store = Attachments(spark, f"file://{tmp_path}/a")
    rows = [(1, 1, "a", "t", b"same"), (2, 1, "b", "t", b"same"), (3, 2, "c", None, b"\x00\xff" * 5000), (4, None, None, None, None), (5, 5, "e", "t", b""), (5, 5, "e", "t", b"")]
    store.put(spark.createDataFrame(rows, KIND))
    files = lambda: sorted(p for p in Path(tmp_path, "a/blobs").rglob("*") if p.is_file() and len(p.name) == 64)
    assert len(files()) == 3
    got = {r["id"]: bytes(r["content"]) for r in store.get().collect()}
    assert got == {1: b"same", 2: b"same", 3: b"\x00\xff" * 5000, 4: b"", 5: b""}
    store.put(spark.createDataFrame([(1, 1, "a", "t", b"new")], KIND))
    assert {r["id"]: bytes(r["content"]) for r in store.get(spark.createDataFrame([(1,), (99,)], "id long")).collect()} == {1: b"new"}
    store.put(spark.createDataFrame([], KIND))
    assert len(files()) == 4


def test_a_damaged_file_is_an_error(spark, tmp_path):
    store = Attachments(spark, f"file://{tmp_path}/a")
    store.put(spark.createDataFrame([(1, 1, "a", "t", b"right")], KIND))
    path = next(p for p in Path(tmp_path, "a/blobs").rglob("*") if p.is_file() and len(p.name) == 64)
    for extra in path.parent.glob(".*.crc"):
        extra.unlink()
    path.write_bytes(b"wrong")
    with pytest.raises(Exception, match="damaged attachment"):
        store.get().collect()


def test_places_follow_the_collation(spark):
    names = ["zebra", "Água", "agua", "água", "Banana", "ágil", "açaí", "acai", "Zé", None, "ze"]
    rows = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "name string, id string").repartition(5)
    got = [r["name"] for r in placed(spark, rows, ["name", "id"]).orderBy("place").collect()]
    assert got == [None, "acai", "açaí", "ágil", "agua", "água", "Água", "Banana", "ze", "Zé", "zebra"]
    assert [r["place"] for r in placed(spark, rows, ["name", "id"]).orderBy("place").collect()] == list(range(1, 12))
    assert placed(spark, rows.limit(0), ["name"]).collect() == []
