"""The workbook data source: round trips, damaged files, failed jobs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import workbooks, xlsx

KIND = workbooks.SCHEMA


def lists(spark, *rows):
    return spark.createDataFrame([(a, i, n, *["x"] * 6, None) for a, i, n in rows], KIND)


def read(spark, path):
    return sorted((r["list"], r["row"], r["name"], r["code"]) for r in workbooks.read_lists(spark, path).collect())


def test_round_trip_with_odd_names(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = [("a", 2, "second"), ("a", 1, "first & <b>"), ("b/c", 1, "Pão"), (None, 1, "no list"), ("b", 1, None), ("b", 2, "left")]
    workbooks.write_lists(lists(spark, *rows), path)
    assert read(spark, path) == [("a", 1, "first & <b>", ""), ("a", 2, "second", ""), ("b", 1, "left", ""), ("b_c", 1, "Pão", ""), ("list", 1, "no list", "")]
    (tmp_path / "w/sub").mkdir()
    (tmp_path / "w/sub/d.xlsx").write_bytes(xlsx.write_rows([xlsx.TEMPLATE, ["deep"]]))
    (tmp_path / "w/bad.xlsx").write_bytes(b"no workbook")
    (tmp_path / "w/_draft-x").mkdir()
    (tmp_path / "w/_draft-x/e.xlsx").write_bytes(xlsx.write_rows([xlsx.TEMPLATE, ["hidden"]]))
    assert [r for r in read(spark, path) if r[0] not in ("a", "b", "b_c", "list")] == [("sub/d", 1, "deep", None)]
    assert spark.read.format("workbook").option("bytes", 1).load(path).rdd.getNumPartitions() == 6


def test_overwrite_append_and_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    assert read(spark, path) == []
    workbooks.write_lists(lists(spark, ("a", 1, "x")), path)
    workbooks.write_lists(lists(spark, ("b", 1, "y")), path)
    assert [r[0] for r in read(spark, path)] == ["a", "b"]
    workbooks.write_lists(lists(spark, ("c", 1, "z")), path, "overwrite")
    assert [r[0] for r in read(spark, path)] == ["c"]
    workbooks.write_lists(lists(spark, ("c", 1, "z")).limit(0), path, "overwrite")
    assert read(spark, path) == []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    workbooks.write_lists(lists(spark, ("a", 1, "x")), path)
    bad = lists(spark, *((f"l{i}", 1, "n") for i in range(40))).withColumn("name", F.when(F.col("list") == "l7", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        workbooks.write_lists(bad, path, "overwrite")
    assert read(spark, path) == [("a", 1, "x", "")]
    with pytest.raises(Exception, match="several partitions"):
        lists(spark, *(("same", i, "n") for i in range(40))).repartition(4).write.format("workbook").mode("append").save(path)
    assert read(spark, path) == [("a", 1, "x", "")] and not list((tmp_path / "w").glob("_draft*"))


def test_a_long_list_becomes_several_workbooks(spark, tmp_path, monkeypatch):
    writer = workbooks.Writer(str(tmp_path), lists(spark, ("a", 1, "x")).schema, False)
    monkeypatch.setattr(workbooks, "ROWS", 10)
    writer.commit([writer.write(iter(lists(spark, *(("a", i, f"n{i}") for i in range(25))).collect())), None])
    assert sorted(p.name for p in tmp_path.glob("*.xlsx")) == ["a-1.xlsx", "a-2.xlsx", "a.xlsx"]
    assert [len(xlsx.list_rows((tmp_path / n).read_bytes())) for n in ("a.xlsx", "a-1.xlsx", "a-2.xlsx")] == [10, 10, 5]


def test_lists_are_read_and_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("concat('l', id % 3) as list", "id div 3 as row", "sha2(cast(id as string), 256) as name", *(f"md5(concat('{f}', id)) as {f}" for f in xlsx.FIELDS[1:]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(workbooks.by_list(workbooks.by_list(rows))).count("Exchange") == 1
    workbooks.write_lists(rows, f"file://{tmp_path}")
    back = workbooks.read_lists(spark, f"file://{tmp_path}")
    assert back.rdd.getNumPartitions() == 3
    assert back.count() == 60_000 and back.select(F.col("row") - 1, *back.columns[2:], "list").exceptAll(rows.selectExpr("row", *xlsx.FIELDS, "list")).count() == 0
