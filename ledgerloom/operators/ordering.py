"""Lists in the order of Brazilian Portuguese, and attachments by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import Model
from ..plans.registry import query
from ..plans.shared import fresh_path
from ..sources.attachments import Attachments

#: Spark's name of the collation; accents count after letters, capitals after accents.
COLLATION = "pt"


def collated(name: str) -> Column:
    return F.collate(F.col(name), COLLATION)


def placed(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their ``place``, from 1, in the order of collated text columns (nulls first; equal rows in any order).

    Rows are dealt by ranges of the order and written, so the ranges stay; a range's first place is the sum of the counts
    before it. No task sorts more than a range, whatever a column's commonest value.
    """
    path = fresh_path(spark, "ordered")
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *map(collated, order)).withColumn("range", F.spark_partition_id())
    dealt.write.parquet(path)
    x = spark.read.schema(dealt.schema).parquet(path)
    counts = x.groupBy("range").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("range", before.alias("before"))
    here = F.row_number().over(Window.partitionBy("range").orderBy(*map(collated, order)))
    return x.withColumn("here", here).join(F.broadcast(counts), "range").withColumn("place", (F.col("before") + F.col("here")).cast("long")).select(*rows.columns, "place")


#: Markets with names that need the collation, in both engines; a missing neighborhood comes last, as ZZZ.
MARKETS = "select c_custkey as market_id, case c_custkey % 6 when 0 then 'Água ' when 1 then 'agua ' when 2 then 'Ágil ' when 3 then 'açaí ' when 4 then 'Acai ' else 'Zé ' end || cast(c_custkey as varchar(20)) as name, case c_nationkey % 5 when 0 then 'ZZZ' when 1 then 'São José ' || c_nationkey when 2 then 'Sao Jose ' || c_nationkey when 3 then 'Ícaro ' || c_nationkey else 'igreja ' || c_nationkey end as neighborhood from customer"


@query("markets_in_order", f"with m as ({MARKETS}) select market_id, neighborhood, name, row_number() over (order by neighborhood collate pt, name collate pt) as place from m")
def markets_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markets by neighborhood and name as pt-BR sorts them."""
    m = spark.sql(MARKETS.replace("from customer", "from {customer}"), customer=Model(spark, sf_dir).table("customer"))
    return placed(spark, m, ["neighborhood", "name"]).select("market_id", "neighborhood", "name", "place")


@query("attachments_by_id", "select page_id as id, strlen(html) as size, sha256(html) as digest, url as name from pages")
def attachments_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages stored as attachments, by two calls of which the second stores them again, and read back: size and digest of what is read."""
    pages = Model(spark, sf_dir).table("pages")
    files = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 7).alias("owner_id"), F.col("url").alias("name"), F.lit("text/html").alias("type"), F.col("html").cast("binary").alias("content"))
    store = Attachments(spark, fresh_path(spark, "attachments"))
    store.put(files)
    store.put(files)
    return store.get().select("id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), "name")
