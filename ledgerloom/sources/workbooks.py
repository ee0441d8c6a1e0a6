"""Workbooks as a data source of Spark: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

Reading: files (``*.xlsx``, at any depth) are dealt to partitions of about ``bytes`` bytes each, or one file; a row an entry, with the file's
path below the folder and its number. Files that are no workbooks give no rows.

Writing: rows of one ``list`` next to each other in a partition (``write_lists`` sorts them so) become a workbook ``<list>.xlsx``, or several, ``<list>-1.xlsx`` and so on,
where it has more than ``ROWS`` rows, which is what a sheet holds. Tasks write to a hidden folder of the job; the driver's commit renames
all files and then adds ``_SUCCESS``; a job that fails removes its folder, so nothing of it is ever read. A task that runs again writes its files under
other names, and only those of the attempt that ended well are renamed. With ``overwrite`` older workbooks go at the commit.

Paths are opened by Arrow's file systems (local disks and mounts, HDFS, object stores); for others ``xlsx.read_lists`` reads through Spark.
Null values are written as empty cells and read as empty texts; rows without a name aren't entries. An empty table writes no workbook.
"""

from __future__ import annotations

import itertools
import operator
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import xlsx

#: Entries of a workbook at most: a sheet has 1,048,576 rows, one of them the header.
ROWS = 1_000_000
#: Bytes of a partition; compressed ones, some 40 to 60 an entry, so a task reads some tens of thousands of entries.
BYTES = 2 << 20
#: Entries of an Arrow batch at most.
BATCH = 10_000
SCHEMA = "list string, row long, " + ", ".join(f"{f} string" for f in xlsx.FIELDS)


def opened(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") and not path.startswith("file:") else path.replace("file:", "file://", 1))


def workbooks(path: str) -> list[tuple[str, int]]:
    """Name below the folder and size of each workbook."""
    from pyarrow import fs

    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    names = [(f.path.removeprefix(root.rstrip("/") + "/"), f.size) for f in found if f.is_file]
    return sorted((n, size) for n, size in names if n.lower().endswith(".xlsx") and not any(p.startswith(("_", ".")) for p in n.split("/")))


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        out, size = [], 0
        for name, own in workbooks(self.path):
            if not out or size + own > self.most:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += own
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator:
        """Arrow batches, so rows aren't converted one by one."""
        import pyarrow as pa

        system, root = opened(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as stream:
                entries = xlsx.list_rows(stream.read())
            for first in range(0, len(entries), BATCH):
                part = entries[first : first + BATCH]
                fields = [pa.array([e.get(f) for e in part], pa.string()) for f in xlsx.FIELDS]
                yield pa.record_batch([pa.array([name[: -len(".xlsx")]] * len(part), pa.string()), pa.array(range(first + 1, first + len(part) + 1), pa.int64()), *fields], ["list", "row", *xlsx.FIELDS])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.fields, self.overwrite, self.draft = path, schema.names, overwrite, f"_draft-{uuid.uuid4().hex}"
        if missing := {"list", *xlsx.FIELDS} - set(self.fields):
            raise ValueError(f"a workbook needs the columns {sorted(missing)}")

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        system.create_dir(f"{root}/{self.draft}", recursive=True)
        names, key, at = [], operator.itemgetter(self.fields.index("list")), operator.itemgetter(*map(self.fields.index, xlsx.FIELDS))
        for name, own in itertools.groupby(rows, key=key):
            for part in itertools.count():
                cells = [["" if v is None else v for v in at(r)] for r in itertools.islice(own, ROWS)]
                if not cells:
                    break
                draft = f"{uuid.uuid4().hex}.xlsx"
                with system.open_output_stream(f"{root}/{self.draft}/{draft}") as stream:
                    stream.write(xlsx.write_rows([xlsx.TEMPLATE, *cells]))
                stem = re.sub(r"[^\w.=-]", "_", "" if name is None else str(name)).lstrip("._") or "list"
                names.append((draft, stem + (f"-{part}" if part else "") + ".xlsx"))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        names = [x for m in messages if m for x in m.names]
        ends = [end for _, end in names]
        if len(set(ends)) < len(ends):
            self.abort(messages)
            raise ValueError("rows of one list are in several partitions, or lists have one name")
        if self.overwrite:
            for name, _ in workbooks(self.path):
                system.delete_file(f"{root}/{name}")
        for draft, end in names:
            system.move(f"{root}/{self.draft}/{draft}", f"{root}/{end}")
        self.abort(messages)
        with system.open_output_stream(f"{root}/_SUCCESS") as stream:
            stream.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.draft}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.draft}")


class ArrowWriter(Writer, DataSourceArrowWriter):
    """Takes rows as Arrow batches."""

    def write(self, batches: Iterator) -> Written:
        return super().write(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


class Workbooks(DataSource):
    """Options: ``path``; ``bytes`` of a partition when read."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytes", BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def by_list(rows: DataFrame) -> DataFrame:
    """Rows dealt out by list. The number of tasks is given, as workbooks cost time and not bytes, by which adaptive execution would join tasks;
    rows that are dealt out so already aren't dealt out again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "list")


def write_lists(lists: DataFrame, path: str, mode: str = "append") -> None:
    """Workbooks of rows of list, row and the fields; a list's rows meet in one task, as they do in one file."""
    register(lists.sparkSession)
    by_list(lists).sortWithinPartitions("list", "row").write.format("workbook").mode(mode).save(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("workbook").load(path)
