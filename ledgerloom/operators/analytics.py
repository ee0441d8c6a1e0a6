"""Spend analytics: dashboard, products, markets, lists, economy and report.

Two readings of active stay apart: dashboard, markets and report use items of active purchases only; catalog,
consumption and economy use items of archived purchases too, as the histories they describe do.
Orders are total: ties go by the keys named in each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..plans import duck as D
from ..plans.model import CTES, Model
from ..plans.registry import query

W = f"with {CTES} "


def money(cents: str | Column) -> Column:
    """Cents as a double."""
    return F.col(cents).cast("double") / 100 if isinstance(cents, str) else cents.cast("double") / 100


def floor2(x: Column) -> Column:
    """Two decimals, half up, without binary rounding of the middle."""
    return F.floor(x * 100 + 0.5) / 100


@query("dashboard_kpis", W + """
select (select cast(sum(total_cents) as double) / 100 from purchases where active) as total,
 (select count(*) from purchases where active) as purchases, (select count(*) from active_items) as items,
 (select count(*) from products) as products, (select count(distinct market_id) from purchases where active) as markets,
 (select cast(sum(discount_cents) as double) / 100 from active_items) as discount""")
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    p = m.active_purchases.agg(money(F.sum("total_cents")).alias("total"), F.count("*").alias("purchases"), F.count_distinct("market_id").alias("markets"))
    i = m.active_items.agg(F.count("*").alias("items"), money(F.sum("discount_cents")).alias("discount"))
    return p.crossJoin(i).crossJoin(m.products.agg(F.count("*").alias("products")))  # three rows of one


@query("active_purchases", W + "select purchase_id, market_id, purchase_date, cast(total_cents as double) / 100 as total, source from purchases where active")
def active_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).active_purchases.select("purchase_id", "market_id", "purchase_date", money("total_cents").alias("total"), "source")


@query("semi_active_items", W + "select purchase_id, product_id, line_number, cast(net_cents as double) / 100 as net from active_items")
def semi_active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).active_items.select("purchase_id", "product_id", "line_number", money("net_cents").alias("net"))


def by_category(m: Model, name: str = "category") -> DataFrame:
    """Net spend by the product's present category: summed by product before the products are joined."""
    sums = m.active_items.groupBy("product_id").agg(F.sum("net_cents").alias("net_cents"))
    joined = sums.join(m.products.select("product_id", "category"), "product_id", "left")
    return joined.groupBy(F.coalesce("category", F.lit("Outros")).alias(name)).agg(F.sum("net_cents").alias("net_cents"))


CATEGORY_SQL = "select coalesce(category, 'Outros') as category, sum(net_cents) as net_cents from active_items left join products using (product_id) group by 1"


@query("spend_by_category", W + f"select category, cast(net_cents as double) / 100 as spend from ({CATEGORY_SQL})")
def spend_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_category(Model(spark, sf_dir)).select("category", money("net_cents").alias("spend")).orderBy(F.desc("spend"), "category")


@query("spend_by_sector", W + "select coalesce(sector_snapshot, 'Outros') as sector, cast(sum(net_cents) as double) / 100 as spend from active_items group by 1 order by 2 desc, 1 limit 8")
def spend_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = Model(spark, sf_dir).active_items.groupBy(F.coalesce("sector_snapshot", F.lit("Outros")).alias("sector")).agg(money(F.sum("net_cents")).alias("spend"))
    return sums.orderBy(F.desc("spend"), "sector").limit(8)  # the chart shows the top 8


#: Our reading of the line status as a health class.
HEALTH = {"O": "Saudável", "F": "Não saudável"}


@query("spend_by_health", W + """, h as (select case health_snapshot when 'O' then 'Saudável' when 'F' then 'Não saudável' else 'Não classificado' end as health, sum(net_cents) as c from active_items group by 1)
select d.health, cast(coalesce(c, 0) as double) / 100 as spend from (values ('Saudável'), ('Não saudável'), ('Não classificado')) d(health) left join h using (health)""")
def spend_by_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = F.coalesce(*(F.when(F.col("health_snapshot") == k, v) for k, v in HEALTH.items()), F.lit("Não classificado"))
    sums = Model(spark, sf_dir).active_items.groupBy(health.alias("health")).agg(F.sum("net_cents").alias("c"))
    classes = spark.createDataFrame([("Saudável",), ("Não saudável",), ("Não classificado",)], "health string")
    return classes.join(sums, "health", "left").select("health", money(F.coalesce("c", F.lit(0))).alias("spend"))


@query("share_of_max", W + f"select category, floor(cast(net_cents as double) / greatest(max(net_cents) over (), 100) * 10000 + 0.5) / 100 as share from ({CATEGORY_SQL})")
def share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = by_category(Model(spark, sf_dir))
    top = sums.agg(F.greatest(F.max("net_cents"), F.lit(100)).alias("top"))
    return sums.crossJoin(F.broadcast(top)).select("category", floor2(F.col("net_cents").cast("double") / F.col("top") * 100).alias("share"))  # one row each


@query("recent_purchases", W + "select purchase_id, market_id, purchase_date, cast(total_cents as double) / 100 as total from purchases where active order by purchase_date desc, purchase_id limit 5")
def recent_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = Model(spark, sf_dir).active_purchases.orderBy(F.desc("purchase_date"), "purchase_id").limit(5)
    return top.select("purchase_id", "market_id", "purchase_date", money("total_cents").alias("total"))


@query("last_purchase", W + "select p.purchase_id, m.name as market, p.purchase_date, cast(total_cents as double) / 100 as total from purchases p left join markets m using (market_id) where p.active order by purchase_date desc, purchase_id limit 1")
def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    last = m.active_purchases.orderBy(F.desc("purchase_date"), "purchase_id").limit(1)
    return last.join(m.markets.select("market_id", F.col("name").alias("market")), "market_id", "left").select("purchase_id", "market", "purchase_date", money("total_cents").alias("total"))


@query("top_category", W + f"select category, cast(net_cents as double) / 100 as spend from ({CATEGORY_SQL}) order by net_cents desc, category limit 1")
def top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_category(Model(spark, sf_dir)).orderBy(F.desc("net_cents"), "category").limit(1).select("category", money("net_cents").alias("spend"))


@query("recurring_products", W + "select product_id, name, n as occurrences from (select product_id, count(*) as n from active_items group by 1 having count(*) > 1 order by 2 desc, 1 limit 5) left join products using (product_id)")
def recurring_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    top = m.active_items.groupBy("product_id").agg(F.count("*").alias("occurrences")).where("occurrences > 1").orderBy(F.desc("occurrences"), "product_id").limit(5)
    return top.join(m.products.select("product_id", "name"), "product_id", "left")


@query("purchase_cards", W + """, l as (select purchase_id, count(*) as n, list(product_id order by line_number, product_id, supplier_id, line_cents, quantity_e3) as ids from items group by 1)
select p.purchase_id, purchase_date, cast(total_cents as double) / 100 as total, coalesce(n, 0) as items,
 coalesce(array_to_string(ids[1:12], ','), '') as shown, greatest(coalesce(n, 0) - 12, 0) as more from purchases p left join l using (purchase_id) where p.active""")
def purchase_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    line = F.struct("line_number", "product_id", "supplier_id", "line_cents", "quantity_e3")
    lines = m.items.groupBy("purchase_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))
    shown = F.array_join(F.transform(F.slice("lines", 1, 12), lambda x: x["product_id"].cast("string")), ",")
    n = F.coalesce("n", F.lit(0))
    return m.active_purchases.join(lines, "purchase_id", "left").select("purchase_id", "purchase_date", money("total_cents").alias("total"), n.alias("items"), F.coalesce(shown, F.lit("")).alias("shown"), F.greatest(n - 12, F.lit(0)).alias("more"))


STATS_SQL = """s as (select market_id, sum(total_cents) as c, count(*) as n, sum(case when source = 'manual-list' then total_cents else 0 end) as mc from purchases where active group by 1)"""


def market_sums(m: Model) -> DataFrame:
    manual = F.sum(F.when(F.col("source") == "manual-list", F.col("total_cents")).otherwise(0))
    return m.active_purchases.groupBy("market_id").agg(F.sum("total_cents").alias("c"), F.count("*").alias("n"), manual.alias("mc"))


@query("market_stats", W + f""", {STATS_SQL}, a as (select market_id, name from markets where active)
select market_id, a.name, cast(coalesce(c, 0) as double) / 100 as total, coalesce(n, 0) as trips, cast(coalesce(mc, 0) as double) / 100 as manual, cast(coalesce(c, 0) - coalesce(mc, 0) as double) / 100 as receipt
from a full outer join s using (market_id)""")
def market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = m.markets.where("active").select("market_id", "name").join(market_sums(m), "market_id", "full_outer")
    return out.select("market_id", "name", money(zero("c")).alias("total"), zero("n").alias("trips"), money(zero("mc")).alias("manual"), money(zero("c") - zero("mc")).alias("receipt"))


@query("markets_by_neighborhood", W + "select coalesce(neighborhood, 'Bairro não informado') as neighborhood, count(*) as markets, min(name) as first_name, max(name) as last_name from markets where active group by 1")
def markets_by_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce("neighborhood", F.lit("Bairro não informado")).alias("neighborhood")
    return Model(spark, sf_dir).markets.where("active").groupBy(key).agg(F.count("*").alias("markets"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("market_directory", W + f""", {STATS_SQL}
select market_id, name, type, neighborhood, cast(coalesce(c, 0) as double) / 100 as total, coalesce(n, 0) as trips from markets left join s using (market_id)
where active and neighborhood in ('NATION_1', 'NATION_2', 'NATION_3') and contains({D.norm("name || ' ' || neighborhood")}, 'customer')""")
def market_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    wanted = m.markets.where("active").where(F.col("neighborhood").isin("NATION_1", "NATION_2", "NATION_3")).where(S.normalize(F.concat_ws(" ", "name", "neighborhood")).contains("customer"))
    return wanted.join(market_sums(m), "market_id", "left").select("market_id", "name", "type", "neighborhood", money(F.coalesce("c", F.lit(0))).alias("total"), F.coalesce("n", F.lit(0)).alias("trips"))


#: Which of a product's items is the latest.
LATEST = ("purchase_date", "purchase_id", "line_number", "supplier_id", "line_cents", "quantity_e3")
DATED_SQL = "dated as (select i.*, p.purchase_date, p.market_id from items i join purchases p using (purchase_id))"
LATEST_SQL = "purchase_date desc, purchase_id desc, line_number desc, supplier_id desc, line_cents desc, quantity_e3 desc"


def dated_items(m: Model) -> DataFrame:
    return m.items.join(m.purchases.select("purchase_id", "purchase_date", "market_id"), "purchase_id")


def product_history(m: Model) -> DataFrame:
    """Count, sums and latest item of each product: one aggregation with partial results, no sort of the items."""
    last = F.max_by(F.struct("unit_price_e4", "quantity_e3"), F.struct(*LATEST))
    return dated_items(m).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("unit_price_e4").alias("su"), F.sum("quantity_e3").alias("sq"), last.alias("last")).select("product_id", "n", "su", "sq", F.col("last.unit_price_e4").alias("lu"), F.col("last.quantity_e3").alias("lq"))


HISTORY_SQL = f"""{DATED_SQL}, ranked as (select *, row_number() over (partition by product_id order by {LATEST_SQL}) as r from dated),
h as (select product_id, count(*) as n, sum(unit_price_e4) as su, sum(quantity_e3) as sq, max(unit_price_e4) filter (r = 1) as lu, max(quantity_e3) filter (r = 1) as lq from ranked group by 1)"""


@query("product_catalog", W + f", {HISTORY_SQL} select product_id, name, brand, category, n as occurrences, cast(lu as double) / 10000 as last_price from products left join h using (product_id) where contains({D.norm("name || ' ' || brand")}, 'widget') and category = 'ECONOMY'")
def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    wanted = m.products.where(S.normalize(F.concat_ws(" ", "name", "brand")).contains("widget")).where("category = 'ECONOMY'")
    return wanted.join(product_history(m), "product_id", "left").select("product_id", "name", "brand", "category", F.col("n").alias("occurrences"), (F.col("lu").cast("double") / 10000).alias("last_price"))


@query("catalog_typeahead", W + f"select product_id, name, brand from products where contains({D.norm('name')}, 'ring') or contains({D.norm('brand')}, 'ring') order by product_id limit 8")
def catalog_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Model(spark, sf_dir).products.where(S.normalize(F.col("name")).contains("ring") | S.normalize(F.col("brand")).contains("ring"))
    return found.orderBy("product_id").limit(8).select("product_id", "name", "brand")  # the list shows 8


@query("product_refs", W + """, a as (select product_id, count(*) as items from items group by 1), b as (select product_id, count(distinct purchase_id) as lists from items join purchases using (purchase_id) where source = 'manual-list' group by 1)
select product_id, coalesce(items, 0) as item_refs, coalesce(lists, 0) as list_refs from products left join a using (product_id) left join b using (product_id)""")
def product_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    a = m.items.groupBy("product_id").agg(F.count("*").alias("a"))
    lists = m.items.join(m.purchases.where("source = 'manual-list'").select("purchase_id"), "purchase_id", "left_semi")
    b = lists.groupBy("product_id").agg(F.count_distinct("purchase_id").alias("b"))
    return m.products.join(a, "product_id", "left").join(b, "product_id", "left").select("product_id", F.coalesce("a", F.lit(0)).alias("item_refs"), F.coalesce("b", F.lit(0)).alias("list_refs"))


def trips(m: Model, key: str) -> DataFrame:
    return m.active_purchases.where("source = 'manual-list'").groupBy(key).agg(F.count("*").alias("n"), F.sum("total_cents").alias("c"), F.max_by("total_cents", F.struct("purchase_date", "purchase_id")).alias("last_c"), F.max("purchase_date").alias("last_date"))


@query("trips_per_list", W + """select market_id as list_id, count(*) as trips, cast(sum(total_cents) as double) / 100 as total, floor(cast(sum(total_cents) as double) / count(*) + 0.5) / 100 as average,
 cast(arg_max(total_cents, (purchase_date, purchase_id)) as double) / 100 as last_total, max(purchase_date) as last_date from purchases where active and source = 'manual-list' group by 1""")
def trips_per_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips(Model(spark, sf_dir), "market_id")
    return t.select(F.col("market_id").alias("list_id"), F.col("n").alias("trips"), money("c").alias("total"), (F.floor(F.col("c").cast("double") / F.col("n") + 0.5) / 100).alias("average"), money("last_c").alias("last_total"), "last_date")


def _report(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("trips"), F.sum("total_cents").alias("c")).select(key, "trips", money("c").alias("total"), (F.floor(F.col("c").cast("double") / F.col("trips") + 0.5) / 100).alias("average"))


REPORT = "count(*) as trips, cast(sum(total_cents) as double) / 100 as total, floor(cast(sum(total_cents) as double) / count(*) + 0.5) / 100 as average"


@query("report_by_market", W + f"select name as market, {REPORT} from purchases p join markets m using (market_id) where p.active group by 1")
def report_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return _report(m.active_purchases.join(m.markets.select("market_id", F.col("name").alias("market")), "market_id"), "market")


@query("report_by_list", W + f"select payment_method as list, {REPORT} from purchases where active and source = 'manual-list' group by 1")
def report_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(Model(spark, sf_dir).active_purchases.where("source = 'manual-list'").withColumnRenamed("payment_method", "list"), "list")


@query("report_totals", W + "select cast(sum(total_cents) as double) / 100 as total, count(*) as trips, count(*) filter (source = 'manual-list') as by_list, count(*) filter (source <> 'manual-list') as by_receipt, floor(cast(sum(total_cents) filter (source = 'manual-list') as double) / count(*) filter (source = 'manual-list') + 0.5) / 100 as list_average from purchases where active")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = F.col("source") == "manual-list"
    sums = Model(spark, sf_dir).active_purchases.agg(F.sum("total_cents").alias("c"), F.count("*").alias("trips"), F.count_if(manual).alias("by_list"), F.count_if(~manual).alias("by_receipt"), F.sum(F.when(manual, F.col("total_cents"))).alias("mc"))
    return sums.select(money("c").alias("total"), "trips", "by_list", "by_receipt", (F.floor(F.col("mc").cast("double") / F.col("by_list") + 0.5) / 100).alias("list_average"))


@query("acquisition_series", W + f""", {DATED_SQL} select product_id, purchase_date, line_number, cast(quantity_e3 as double) / 1000 as quantity,
 floor(cast(quantity_e3 as double) / max(quantity_e3) over (partition by product_id) * 10000 + 0.5) / 100 as height, count(*) over (partition by product_id) >= 3 as has_text from dated""")
def acquisition_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against its product's largest; sums come from an aggregation with partial results, so a hot product is no one task's."""
    m = Model(spark, sf_dir)
    q = F.col("quantity_e3").cast("double")
    most = m.items.join(m.purchases.select("purchase_id"), "purchase_id", "left_semi").groupBy("product_id").agg(F.max("quantity_e3").alias("most"), F.count("*").alias("n"))
    return dated_items(m).join(most, "product_id").select("product_id", "purchase_date", "line_number", (q / 1000).alias("quantity"), floor2(q / F.col("most") * 100).alias("height"), (F.col("n") >= 3).alias("has_text"))


@query("qty_excess", W + f", {HISTORY_SQL} select product_id, n as occurrences, cast(lq as double) / 1000 as last_quantity, floor(cast(sq as double) / n + 0.5) / 1000 as mean_quantity from h where n >= 2 and 2 * lq * n > 3 * sq")
def qty_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = product_history(Model(spark, sf_dir)).where("n >= 2 and 2 * lq * n > 3 * sq")
    return h.select("product_id", F.col("n").alias("occurrences"), (F.col("lq").cast("double") / 1000).alias("last_quantity"), (F.floor(F.col("sq").cast("double") / F.col("n") + 0.5) / 1000).alias("mean_quantity"))


OPPORTUNITY = "cast(floor((cast(lu as double) - cast(su as double) / n) / 100 + 0.5) as bigint)"


@query("price_opportunity", W + f", {HISTORY_SQL} select product_id, cast(lu as double) / 10000 as last_price, floor(cast(su as double) / n + 0.5) / 10000 as mean_price, cast({OPPORTUNITY} as double) / 100 as opportunity from h where n >= 2 and 10 * lu * n > 11 * su")
def price_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = product_history(Model(spark, sf_dir)).where("n >= 2 and 10 * lu * n > 11 * su").withColumn("o", F.expr(OPPORTUNITY))
    return h.select("product_id", (F.col("lu").cast("double") / 10000).alias("last_price"), (F.floor(F.col("su").cast("double") / F.col("n") + 0.5) / 10000).alias("mean_price"), money("o").alias("opportunity"))


@query("economy_summary", W + f""", {HISTORY_SQL} select (select cast(sum(discount_cents) as double) / 100 from active_items) as confirmed, cast(sum(case when 10 * lu * n > 11 * su then {OPPORTUNITY} end) as double) / 100 as opportunity,
 count(*) filter (10 * lu * n > 11 * su) as above, count(*) filter (2 * lq * n > 3 * sq) as excess from h where n >= 2""")
def economy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    above = F.expr("10 * lu * n > 11 * su")
    h = product_history(m).where("n >= 2").agg(money(F.sum(F.when(above, F.expr(OPPORTUNITY)))).alias("opportunity"), F.count_if(above).alias("above"), F.count_if(F.expr("2 * lq * n > 3 * sq")).alias("excess"))
    return m.active_items.agg(money(F.sum("discount_cents")).alias("confirmed")).crossJoin(h)  # one row each


ACTIVE_HISTORY_SQL = HISTORY_SQL.replace("from items i join purchases p using (purchase_id)", "from items i join purchases p using (purchase_id) where p.active")


@query("insights", W + f""", {ACTIVE_HISTORY_SQL}, man as (select * from purchases where active and source = 'manual-list')
select 1 as priority, 'trip-average' as kind, cast(count(*) as varchar) as subject, floor(cast(sum(total_cents) as double) / count(*) + 0.5) / 100 as amount from man having count(*) > 0
union all select 2, 'quantity', cast(product_id as varchar), cast(lq as double) / 1000 from h where n >= 2 and 2 * lq * n > 3 * sq
union all select 3, 'last-movement', cast(product_id as varchar), cast(quantity_e3 as double) / 1000 from (select * from dated order by {LATEST_SQL}, product_id limit 1)
union all select 4, 'top-category', category, cast(net_cents as double) / 100 from ({CATEGORY_SQL} order by net_cents desc, category limit 1)
union all select 5, 'top-market', cast(market_id as varchar), cast(c as double) / 100 from (select market_id, sum(total_cents) as c from man group by 1 order by 2 desc, 1 limit 1)""")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    manual = m.active_purchases.where("source = 'manual-list'")
    dated = m.items.join(m.active_purchases.select("purchase_id", "purchase_date"), "purchase_id")
    last = F.max_by(F.struct("unit_price_e4", "quantity_e3"), F.struct(*LATEST))
    h = dated.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("quantity_e3").alias("sq"), last.alias("last")).where("n >= 2 and 2 * last.quantity_e3 * n > 3 * sq")

    def row(priority: int, kind: str, df: DataFrame, subject: Column, amount: Column) -> DataFrame:
        return df.select(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), amount.alias("amount"))

    mean = manual.agg(F.count("*").alias("n"), F.sum("total_cents").alias("c")).where("n > 0")
    newest = dated.orderBy(*(F.desc(c) for c in LATEST), "product_id").limit(1)
    top = manual.groupBy("market_id").agg(F.sum("total_cents").alias("c")).orderBy(F.desc("c"), "market_id").limit(1)
    parts = [
        row(1, "trip-average", mean, F.col("n"), F.floor(F.col("c").cast("double") / F.col("n") + 0.5) / 100),
        row(2, "quantity", h, F.col("product_id"), F.col("last.quantity_e3").cast("double") / 1000),
        row(3, "last-movement", newest, F.col("product_id"), F.col("quantity_e3").cast("double") / 1000),
        row(4, "top-category", by_category(m).orderBy(F.desc("net_cents"), "category").limit(1), F.col("category"), money("net_cents")),
        row(5, "top-market", top, F.col("market_id"), money("c")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("agent_context")
def agent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON by section; the last 80 items are a limit of the context itself."""
    m = Model(spark, sf_dir)
    summary = dashboard_kpis(spark, sf_dir)
    recent = m.items.join(m.active_purchases.select("purchase_id", "purchase_date", "market_id"), "purchase_id").orderBy(*(F.desc(c) for c in LATEST), "product_id").limit(80)
    recent = recent.join(m.products.select("product_id", "name"), "product_id", "left")
    parts = [
        summary.select(F.lit("summary").alias("section"), F.to_json(F.struct("*")).alias("json")),
        m.active_purchases.select(F.lit("purchase"), F.to_json(F.struct("purchase_id", "purchase_date", "market_id", money("total_cents").alias("total")))),
        m.products.select(F.lit("product"), F.to_json(F.struct("*"))),
        recent.select(F.lit("recent-item"), F.to_json(F.struct("purchase_date", "name", "quantity", money("net_cents").alias("total"), "market_id"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("price_history_by_market", W + f", {DATED_SQL} select product_id, market_id, count(*) as n, cast(min(unit_price_e4) as double) / 10000 as least, cast(max(unit_price_e4) as double) / 10000 as most, floor(cast(sum(unit_price_e4) as double) / count(*) + 0.5) / 10000 as mean from dated group by 1, 2")
def price_history_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda c: c.cast("double") / 10000
    return dated_items(Model(spark, sf_dir)).groupBy("product_id", "market_id").agg(F.count("*").alias("n"), u(F.min("unit_price_e4")).alias("least"), u(F.max("unit_price_e4")).alias("most"), (F.floor(F.sum("unit_price_e4").cast("double") / F.count("*") + 0.5) / 10000).alias("mean"))


@query("purchase_interval", W + ", g as (select market_id, date_diff('day', lag(purchase_date) over (partition by market_id order by purchase_date, purchase_id), purchase_date) as gap from purchases where active) select market_id, count(gap) as gaps, floor(cast(sum(gap) as double) / count(gap) * 100 + 0.5) / 100 as mean_days, cast(median(gap) as double) as median_days from g group by 1 having count(gap) > 0")
def purchase_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("market_id").orderBy("purchase_date", "purchase_id")
    gaps = Model(spark, sf_dir).active_purchases.select("market_id", F.datediff("purchase_date", F.lag("purchase_date").over(w)).alias("gap"))
    return gaps.where("gap is not null").groupBy("market_id").agg(F.count("gap").alias("gaps"), floor2(F.sum("gap").cast("double") / F.count("gap")).alias("mean_days"), F.median("gap").cast("double").alias("median_days"))
