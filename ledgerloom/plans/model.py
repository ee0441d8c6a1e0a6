"""The purchase model over the driver's tables; money is held as whole cents.

Nothing is cached or broadcast here: each function is a plan that Catalyst prunes. Dimension tables
become broadcast joins by their statistics, and adaptive execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PURCHASES = """
select o_orderkey as purchase_id, o_custkey as market_id, cast(o_orderdate as date) as purchase_date,
 cast(floor(o_totalprice * 100 + 0.5) as bigint) as total_cents, o_orderstatus <> 'P' as active,
 case when o_orderpriority = '5-LOW' then 'manual-list' else 'import' end as source, o_orderpriority as payment_method
from orders"""
ITEMS = """
select l_orderkey as purchase_id, l_partkey as product_id, l_suppkey as supplier_id, l_linenumber as line_number, l_quantity as quantity,
 cast(floor(l_extendedprice * 100 + 0.5) as bigint) as line_cents,
 cast(floor(l_extendedprice * l_discount * 100 + 0.5) as bigint) as discount_cents,
 cast(floor(l_extendedprice * 100 + 0.5) as bigint) - cast(floor(l_extendedprice * l_discount * 100 + 0.5) as bigint) as net_cents,
 cast(floor(l_extendedprice / l_quantity * 10000 + 0.5) as bigint) as unit_price_e4,
 cast(floor(l_quantity * 1000 + 0.5) as bigint) as quantity_e3, l_returnflag as sector_snapshot, l_linestatus as health_snapshot
from lineitem"""
PRODUCTS = "select p_partkey as product_id, p_name as name, p_brand as brand, p_type as category, p_size as pack from part"
MARKETS = """
select c_custkey as market_id, c_name as name, c_mktsegment as type, n_name as neighborhood, r_name as city, c_acctbal >= 0 as active
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

#: Common table expressions of the model, for the SQL that queries are held against.
CTES = f"purchases as ({PURCHASES}), items as ({ITEMS}), products as ({PRODUCTS}), markets as ({MARKETS}), active_items as (select * from items where purchase_id in (select purchase_id from purchases where active))"


class Model:
    """Lazy DataFrames of the model in a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(self._bound(text, tables), **{t: self.table(t) for t in tables})

    @staticmethod
    def _bound(text: str, tables: tuple[str, ...]) -> str:
        head, sep, tail = text.rpartition("\nfrom ") if "\nfrom " in text else text.rpartition(" from ")
        for t in tables:
            tail = tail.replace(t, "{" + t + "}", 1)
        return head + sep + tail

    @property
    def purchases(self) -> DataFrame:
        return self._sql(PURCHASES, "orders")

    @property
    def active_purchases(self) -> DataFrame:
        return self.purchases.where("active")

    @property
    def items(self) -> DataFrame:
        return self._sql(ITEMS, "lineitem")

    @property
    def active_items(self) -> DataFrame:
        return self.items.join(self.active_purchases.select("purchase_id"), "purchase_id", "left_semi")

    @property
    def products(self) -> DataFrame:
        return self._sql(PRODUCTS, "part")

    @property
    def markets(self) -> DataFrame:
        return self._sql(MARKETS, "customer", "nation", "region")
