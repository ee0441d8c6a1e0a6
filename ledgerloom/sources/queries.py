"""Queries of the sources: scans, lookups and workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import CTES, Model
from ..plans.registry import query
from ..plans.shared import fresh_path
from . import workbooks

W = f"with {CTES} "


@query("table_scan", W + "select market_id, name, type, neighborhood, city, active from markets")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).markets


@query("point_lookup", W + "select purchase_id, market_id, purchase_date from purchases where purchase_id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).purchases.where("purchase_id = 42").select("purchase_id", "market_id", "purchase_date")


LISTS = """select cast(l_suppkey as varchar(20)) as list, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as row, p_name as name, p_brand as brand, p_type as category, cast(p_size as varchar(20)) || ' un & <x>' as pack, 'un' as unit, cast(l_quantity as varchar(40)) as quantity, case when l_suppkey % 2 = 0 then 'Mercado "Boa" Vista' else '' end as market, '789' || cast(l_partkey as varchar(20)) as code from lineitem join part on l_partkey = p_partkey"""


@query("xlsx_list_rows", LISTS)
def xlsx_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as the lists of their suppliers, written as workbooks and read back row for row."""
    m, path = Model(spark, sf_dir), fresh_path(spark, "workbooks")
    lines = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    dealt = workbooks.by_list(lines.select(F.col("l_suppkey").cast("string").alias("list"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_name", "p_brand", "p_type", "p_size"))
    row = F.row_number().over(Window.partitionBy("list").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    text = lambda c: F.col(c).cast("string")
    lists = dealt.select(
        "list", row.alias("row"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.concat(text("p_size"), F.lit(" un & <x>")).alias("pack"), F.lit("un").alias("unit"),
        text("l_quantity").alias("quantity"), F.when(F.col("l_suppkey") % 2 == 0, 'Mercado "Boa" Vista').otherwise("").alias("market"), F.concat(F.lit("789"), text("l_partkey")).alias("code"),
    )
    workbooks.write_lists(lists, path)
    return workbooks.read_lists(spark, path)


@query("database_snapshot", "select 'orders' as store, count(*) as rows from orders union all select 'lineitem', count(*) from lineitem union all select 'part', count(*) from part union all select 'customer', count(*) from customer union all select 'events', count(*) from events")
def database_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    parts = [m.table(t).agg(F.lit(t).alias("store"), F.count("*").alias("rows")).select("store", "rows") for t in ("orders", "lineitem", "part", "customer", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
