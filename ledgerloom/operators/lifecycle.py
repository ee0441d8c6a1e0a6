"""Data lifecycle: upserts, recomputation, migrations, lists, trips and question routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..plans import duck as D
from ..plans.model import CTES, Model
from ..plans.registry import Extended, Fixture, query

W = f"with {CTES} "


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key: an aggregation with partial results, so a hot key meets no single task."""
    rows = old.unionByName(new)
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("row")).select(key, "row.*")


@query("upsert_latest", "select user_id, event_id, event_type, cast(floor(value * 100 + 0.5) as bigint) as value_cents from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Model(spark, sf_dir).table("events").select("user_id", "event_id", "event_type", F.floor(F.col("value") * 100 + 0.5).alias("value_cents"), F.struct("ts", "event_id").alias("at"))
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "at").drop("at")


@query("recompute_lines", W + "select purchase_id, line_number, product_id, cast(floor(quantity * (cast(unit_price_e4 as double) / 10000) * 100 + 0.5) as double) / 100 as line_total, cast(floor(quantity * (cast(unit_price_e4 as double) / 10000) * 100 - discount_cents + 0.5) as double) / 100 as net from items")
def recompute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.col("quantity") * (F.col("unit_price_e4").cast("double") / 10000) * 100
    return Model(spark, sf_dir).items.select("purchase_id", "line_number", "product_id", (F.floor(gross + 0.5).cast("double") / 100).alias("line_total"), (F.floor(gross - F.col("discount_cents") + 0.5).cast("double") / 100).alias("net"))


@query("backfill_dates", W + "select i.purchase_id, i.line_number, i.product_id, p.purchase_date from items i left join purchases p using (purchase_id)")
def backfill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return m.items.select("purchase_id", "line_number", "product_id").join(m.purchases.select("purchase_id", "purchase_date"), "purchase_id", "left")


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


OLD = Extended(
    "product_id string, sector string, category string, health string, active boolean", [("a", "Bebidas", "x", "Saudável", None), ("b", None, "Biscoitos", "Moderado", True), ("c", "?", "Mercearia", "Evitar", False), ("d", None, None, None, None), ("e", "Frios", "Frios", "talvez", True)],
    "select 'p' || p_partkey as product_id, case p_partkey % 4 when 0 then 'Bebidas' when 1 then p_type when 2 then 'Frios' end as sector, case p_partkey % 6 when 0 then 'Padaria' when 1 then 'Mercearia' when 2 then 'Frios' when 3 then 'Limpeza' else p_brand end as category, case p_size % 5 when 0 then 'Moderado' when 1 then 'Evitar' when 2 then 'Saudável' else p_brand end as health, case when p_partkey % 3 = 0 then null else p_partkey % 2 = 0 end as active from {part}",
)


@query("migrate_sector", f"with {OLD.cte('t')}, s as (select product_id, case when sector in ({', '.join(map(D.q, V.SECTORS))}) then sector when category in ({', '.join(map(D.q, V.LEGACY_SECTORS))}) then {D.lookup('category', V.LEGACY_SECTORS)} when category in ({', '.join(map(D.q, V.SECTORS))}) then category else 'Outros' end as sector, case when health in ({', '.join(map(D.q, V.HEALTH_CLASSES))}) then health when health in ('Moderado', 'Evitar') then 'Não saudável' else 'Não classificado' end as health, coalesce(active, true) as active from t) select *, sector as category from s")
def migrate_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older sectors and health classes become present ones; a missing flag means active."""
    sector = F.when(F.col("sector").isin(V.SECTORS), F.col("sector")).otherwise(F.coalesce(mapped(F.col("category"), V.LEGACY_SECTORS), F.when(F.col("category").isin(V.SECTORS), F.col("category")), F.lit("Outros")))
    health = F.when(F.col("health").isin(V.HEALTH_CLASSES), F.col("health")).otherwise(F.coalesce(mapped(F.col("health"), V.LEGACY_HEALTH), F.lit("Não classificado")))
    return OLD.df(spark, sf_dir).select("product_id", sector.alias("sector"), health.alias("health"), F.coalesce("active", F.lit(True)).alias("active")).withColumn("category", F.col("sector"))


@query("list_progress", "select user_id as list_id, count(*) filter (event_type <> 'view') as included, count(*) filter (event_type = 'click') as bought, count(*) filter (event_type not in ('view', 'click')) as remaining from events group by 1")
def list_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as list entries: all but views are included, clicks are checked."""
    kind = F.col("event_type")
    return Model(spark, sf_dir).table("events").groupBy(F.col("user_id").alias("list_id")).agg(F.count_if(kind != "view").alias("included"), F.count_if(kind == "click").alias("bought"), F.count_if(~kind.isin("view", "click")).alias("remaining"))


TRIPS = Extended(
    "list_id string, product_id string, qty double, price double, checked boolean, session_id string", [("l1", "a", 2.0, 3.335, True, "s1"), ("l1", "b", 1.0, 0.0, True, "s1"), ("l1", "c", 0.0, 5.0, True, "s1"), ("l1", "d", 1.0, 5.0, False, "s1"), ("l2", "a", 1.0, None, True, "s2")],
    "select 'l' || l_suppkey as list_id, cast(l_partkey as varchar(20)) as product_id, case when l_linenumber = 3 then 0 else l_quantity end as qty, case when l_linenumber = 2 then 0 else l_extendedprice end as price, l_orderkey % 3 <> 0 as checked, 's' || (l_orderkey % 10) as session_id from {lineitem}",
)


@query("trip_items", f"with {TRIPS.cte('t')} select list_id, session_id, product_id, greatest(0.001::double, case when coalesce(qty, 0) = 0 then 1.0::double else qty end) as quantity, floor(greatest(0.001::double, case when coalesce(qty, 0) = 0 then 1.0::double else qty end) * price * 100 + 0.5) / 100 as line_total from t where checked and price > 0")
def trip_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked entries with a price become items; a trip's total is never split over the others."""
    lists = TRIPS.df(spark, sf_dir).groupBy("list_id", "session_id").agg(F.collect_list(F.struct("product_id", "qty", "price", "checked")).alias("items"))
    x = lists.select("list_id", "session_id", F.explode(F.filter("items", lambda i: i["checked"] & (i["price"] > 0))).alias("i"))
    qty = F.greatest(F.lit(0.001), F.when(F.coalesce("i.qty", F.lit(0.0)) == 0, 1.0).otherwise(F.col("i.qty")))
    return x.select("list_id", "session_id", "i.product_id", qty.alias("quantity"), S.round2(qty * F.col("i.price")).alias("line_total"))


#: Route of a normalized question, by the first pattern that it has.
ROUTES = [("ultima compra|ultima ida", "last_purchase"), ("maior gasto|categoria", "top_category"), ("mais de uma vez|recorrentes|repetid", "recurring_products"), ("como funciona a edicao|editar compra|corrigir", "edit_help"), ("melhor preco|onde .*preco|mercado", "market_help")]
QUESTIONS = Fixture("conv_id long, turn long, text string", [(-1, 0, "Qual foi minha última compra?"), (-1, 1, "onde está o melhor PREÇO"), (-1, 2, "itens repetidos"), (-1, 3, "categoria de maior gasto"), (-1, 4, "Como funciona a edição?"), (-1, 5, None)])


@query("route_question", f"with {QUESTIONS.cte('f')}, t as (select * from f union all select conv_id, turn, text from conversations where role = 'user') select conv_id, turn, case " + " ".join(f"when regexp_matches({D.norm('text')}, '{p}') then '{r}'" for p, r in ROUTES) + " else 'default' end as route from t")
def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = Model(spark, sf_dir).table("conversations").where("role = 'user'").select("conv_id", "turn", "text")
    n = S.normalize(F.col("text"))
    route = F.coalesce(*(F.when(n.rlike(p), r) for p, r in ROUTES), F.lit("default"))
    return QUESTIONS.df(spark).unionByName(asked).select("conv_id", "turn", route.alias("route"))


@query("archive_rows", W + "select purchase_id, active and purchase_date >= date '1996-01-01' as active, case when active and purchase_date < date '1996-01-01' then purchase_date end as archived_at from purchases")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft delete: rows stay, with the flag off and a date."""
    old = F.col("purchase_date") < F.lit("1996-01-01").cast("date")
    return Model(spark, sf_dir).purchases.select("purchase_id", (F.col("active") & ~old).alias("active"), F.when(F.col("active") & old, F.col("purchase_date")).alias("archived_at"))


@query("list_sessions", "with e as (select user_id, event_id, ts, case when event_type = 'purchase' then 1 else 0 end as ends from events), s as (select *, coalesce(sum(ends) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as session from e) select user_id as list_id, cast(session as bigint) as session, count(*) as entries from s group by 1, 2")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit sessions of a list: a purchase closes one, the next entry opens another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = Model(spark, sf_dir).table("events")
    s = e.select("user_id", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(w), F.lit(0)).alias("session"))
    return s.groupBy(F.col("user_id").alias("list_id"), "session").agg(F.count("*").alias("entries"))
