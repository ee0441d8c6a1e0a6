"""Backups: one JSON folder a table and a manifest with a format tag; restore checks the tag first.

Binary columns travel as base64 text. Tables are written and read in parallel and never gathered.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

FORMAT, VERSION = "ledgerloom-backup", 7


def _coded(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, BinaryType) else f.dataType, f.nullable) for f in schema])


def export_backup(tables: dict[str, DataFrame], path: str) -> None:
    """Writes all tables, then the manifest: a backup without a manifest isn't whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        binary = [f.name for f in df.schema if isinstance(f.dataType, BinaryType)]
        df.withColumns({c: F.base64(c) for c in binary}).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
    rows = [(FORMAT, VERSION, name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "format string, schema_version int, name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def restore_backup(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup with their types; an unknown format is refused."""
    manifest = spark.read.schema("format string, schema_version int, name string, schema string").json(f"{path}/manifest").collect()  # a row a table
    if not manifest or any(r["format"] != FORMAT for r in manifest):
        raise ValueError(f"{path} is no {FORMAT}")
    out = {}
    for r in manifest:
        schema = StructType.fromJson(json.loads(r["schema"]))
        df = spark.read.schema(_coded(schema)).json(f"{path}/{r['name']}")
        out[r["name"]] = df.withColumns({f.name: F.unbase64(f.name) for f in schema if isinstance(f.dataType, BinaryType)}).select([f.name for f in schema])
    return out
