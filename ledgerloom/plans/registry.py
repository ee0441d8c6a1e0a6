"""Registry of queries and of the DuckDB SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under ``name``, with SQL for the same rows if there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


TYPES = {"string": "varchar", "long": "bigint", "int": "integer", "double": "double", "boolean": "boolean", "array<string>": "varchar[]"}


class Fixture:
    """Rows written in the code, as a DataFrame and as a common table expression."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def cte(self, name: str) -> str:
        fields = [c.strip().split(" ") for c in self.schema.split(", ")]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"cast({n} as {TYPES[t]}) as {n}" for n, t in fields)
        return f"{name} as (select {casts} from (values {rows}) v({', '.join(n for n, _ in fields)}))"


class Extended(Fixture):
    """A fixture's rows, and rows that a statement makes of tables: odd cases by hand, the bulk from data.

    The statement runs in both engines, names tables in braces and gives the fixture's columns.
    """

    def __init__(self, schema: str, rows: list[tuple], more: str):
        super().__init__(schema, rows)
        self.more, self.tables = more, sorted(set(re.findall(r"\{(\w+)\}", more)))

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = super().df(spark)
        made = spark.sql(self.more, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})
        return own.unionByName(made.select(*(made[f.name].cast(f.dataType) for f in own.schema)))

    def cte(self, name: str) -> str:
        fields = [c.strip().split(" ") for c in self.schema.split(", ")]
        head, _, body = super().cte(name).partition(" as (")
        casts = ", ".join(f"cast({n} as {TYPES[t]}) as {n}" for n, t in fields)
        return f"{head} as ({body[:-1]} union all select {casts} from ({self.more.format(**{t: t for t in self.tables})}))"
