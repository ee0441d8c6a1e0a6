"""What changes stored rows: puts with protected dates, resets, restores; and lines that keep what held on their date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import CTES, Model
from ..plans.registry import query
from ..plans.shared import fresh_path
from ..sources import backup
from ..sources.store import Store, lock

W = f"with {CTES} "
PURCHASE = "purchase_id long, purchase_date date, total_cents long"
ADDED = 2_000_000_000
#: Every tenth purchase is edited with another date and total, and every fiftieth comes again as a new one, a month later. Runs in both engines.
EDITS = f"select purchase_id, case when purchase_id % 20 = 0 then purchase_date else purchase_date + interval 1 day end as purchase_date, total_cents + 100 as total_cents from purchases where purchase_id % 10 = 0 union all select purchase_id + {ADDED}, purchase_date + interval 1 month, total_cents from purchases where purchase_id % 50 = 0"


def purchase_store(spark: SparkSession, m: Model) -> Store:
    """All purchases in a store of their own."""
    store = Store(spark, fresh_path(spark, "purchases"), PURCHASE, "purchase_id")
    store.replace(m.purchases.select("purchase_id", "purchase_date", "total_cents"), batch="load")
    return store


def edits_of(spark: SparkSession, m: Model) -> DataFrame:
    return spark.sql(EDITS.replace("from purchases", "from {purchases}"), purchases=m.purchases).withColumn("purchase_date", F.col("purchase_date").cast("date"))


def put_purchases(store: Store, edits: DataFrame, batch: str) -> DataFrame:
    """Stores edits whose dates can't change; gives the ids of those that tried to."""
    locked = lock(store, edits, "purchase_date")
    tried = locked.where("blocked").select("purchase_id")
    store.upsert(locked.drop("blocked"), batch=batch)
    return tried


@query("date_protection", W + f", e as ({EDITS}) select p.purchase_id, p.purchase_date, coalesce(e.total_cents, p.total_cents) as total_cents, e.purchase_date is not null and e.purchase_date <> p.purchase_date as blocked from purchases p left join e using (purchase_id) union all select purchase_id, cast(purchase_date as date), total_cents, false from e where purchase_id >= {ADDED}")
def date_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits put into the store, and put again by a retry: the date of a stored purchase wins, a try to change it is marked."""
    m = Model(spark, sf_dir)
    store = purchase_store(spark, m)
    edits = edits_of(spark, m)
    blocked = lock(store, edits, "purchase_date").where("blocked").select("purchase_id", F.lit(True).alias("blocked"))  # reads the version of now
    for _ in range(2):
        put_purchases(store, edits, "edits")
    return store.read().join(blocked, "purchase_id", "left").select("purchase_id", "purchase_date", "total_cents", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query("store_versions", W + f", e as ({EDITS}), a as (select p.purchase_id, coalesce(e.total_cents, p.total_cents) as c from purchases p left join e using (purchase_id) union all select purchase_id, total_cents from e where purchase_id >= {ADDED}) select 1::bigint as version, count(*) as rows, sum(total_cents)::bigint as cents from purchases union all select 2, count(*), sum(c)::bigint from a union all select 3, count(*), sum(c)::bigint from a where purchase_id % 3 <> 0 union all select 4, count(*), sum(c)::bigint from a")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store loaded, edited, without every third purchase, and rolled back: rows and cents of each version."""
    m = Model(spark, sf_dir)
    store = purchase_store(spark, m)
    put_purchases(store, edits_of(spark, m), "edits")
    store.delete(store.read().where("purchase_id % 3 = 0"), batch="delete")
    store.roll_back(2)
    out = None
    for v in store.versions():
        part = store.read(v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("rows"), F.sum("total_cents").alias("cents"))
        out = part if out is None else out.unionByName(part)
    return out


#: Stores of the app, the driver table that stands for each, and its key; those of lines and settings are made up of what tells rows apart.
STORES = {"markets": ("customer", "c_custkey"), "products": ("part", "p_partkey"), "purchases": ("orders", "o_orderkey"), "lists": ("events", "event_id"), "attachments": ("pages", "page_id"), "settings": ("region", "r_regionkey")}


def reset(stores: dict[str, Store], kept: tuple[str, ...] = ("settings",)) -> None:
    """All stores but the kept ones become empty, by a version each."""
    for name, store in stores.items():
        if name not in kept:
            store.replace()


@query("reset_user_data", " union all ".join(f"select '{s}' as store, count(*) as before, {'count(*)' if s == 'settings' else '0::bigint'} as after from {t}" for s, (t, _) in STORES.items()))
def reset_user_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores loaded with whole tables and reset: rows of the version before and of the last one."""
    m, stores = Model(spark, sf_dir), {}
    for name, (table, key) in STORES.items():
        rows = m.table(table)
        stores[name] = Store(spark, fresh_path(spark, name), rows.schema, key)
        stores[name].replace(rows)
    reset(stores)
    out = None
    for name, store in stores.items():
        counts = store.read(1).agg(F.count("*").alias("before")).join(store.read().agg(F.count("*").alias("after")))  # one row each
        part = counts.select(F.lit(name).alias("store"), "before", "after")
        out = part if out is None else out.unionByName(part)
    return out


def restore(stores: dict[str, Store], path: str) -> None:
    """What a backup has of each store goes in place of the store's rows; nothing changes if the backup isn't one."""
    spark = next(iter(stores.values())).spark
    tables = backup.restore_backup(spark, path)
    for name, rows in tables.items():
        stores[name].replace(rows)


@query("backup_restore", W + "select 'purchases' as store, purchase_id as id, cast(purchase_date as varchar) || ' ' || total_cents as row from purchases union all select 'markets', c_custkey, c_name || ' ' || c_nationkey from customer")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores backed up, changed beyond recognition, and restored from the backup."""
    m, path = Model(spark, sf_dir), fresh_path(spark, "backup")
    customers = m.table("customer").select("c_custkey", "c_name", "c_nationkey")
    stores = {"purchases": purchase_store(spark, m), "markets": Store(spark, fresh_path(spark, "markets"), customers.schema, "c_custkey")}
    stores["markets"].replace(customers)
    backup.export_backup({name: store.read() for name, store in stores.items()}, path)
    put_purchases(stores["purchases"], edits_of(spark, m), "edits")
    stores["markets"].replace()
    restore(stores, path)
    p = stores["purchases"].read().select(F.lit("purchases").alias("store"), F.col("purchase_id").alias("id"), F.concat_ws(" ", F.col("purchase_date").cast("string"), F.col("total_cents").cast("string")).alias("row"))
    c = stores["markets"].read().select(F.lit("markets").alias("store"), F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string")).alias("row"))
    return p.unionByName(c)


#: Edits of products' sectors: one for each at first, and up to two later. Runs in both engines.
SECTOR_EDITS = "select p_partkey as product_id, date '1990-01-01' as since, p_type as sector from part where p_partkey % 7 <> 0 union all select p_partkey, date '1995-01-01' + cast(p_partkey % 1000 as int), p_brand from part where p_partkey % 3 = 0 union all select p_partkey, date '1997-01-01' + cast(p_partkey % 500 as int), 'Outros' from part where p_partkey % 5 = 0"


def valid_ranges(edits: DataFrame, key: str, since: str) -> DataFrame:
    """Rows with ``until``, the day from which the key's next row holds (null for the last); of several rows of a day one stays."""
    others = [c for c in edits.columns if c not in (key, since)]
    one = edits.groupBy(key, since).agg(F.max(F.struct(*others)).alias("row")).select(key, since, "row.*")
    return one.withColumn("until", F.lead(since).over(Window.partitionBy(key).orderBy(since)))


def as_of(facts: DataFrame, history: DataFrame, key: str, day: str, since: str = "since") -> DataFrame:
    """Facts with the history's row that held on their day, nulls where none did.

    A key's history is one sorted array, so a fact meets one row, not a row a range or a day: the join is on the key
    alone (hot keys are split like those of any join), and a fact stays one row.
    """
    others = [c for c in history.columns if c != key]
    rows = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(since, *(c for c in others if c != since)))).alias("history"))
    held = F.filter("history", lambda r: r[since] <= F.col(day))
    return facts.join(rows, key, "left").withColumn("held", F.element_at(F.when(F.size(held) > 0, held), -1)).select(*facts.columns, *(F.col(f"held.{c}").alias(c) for c in others))


@query("snapshot_as_of", W + f", h as ({SECTOR_EDITS}), x as (select h.*, cast(lead(since) over (partition by product_id order by since) as date) as until from h), l as (select purchase_id, line_number, product_id, line_cents, purchase_date from items left join purchases using (purchase_id)) select l.purchase_id, line_number, l.product_id, line_cents, purchase_date, sector, cast(since as date) as since, until from l left join x on x.product_id = l.product_id and since <= purchase_date and (until is null or purchase_date < until)")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the sector that its product had on the day of the purchase, and since and until when."""
    m = Model(spark, sf_dir)
    lines = m.items.select("purchase_id", "line_number", "product_id", "line_cents").join(m.purchases.select("purchase_id", "purchase_date"), "purchase_id", "left")
    history = valid_ranges(spark.sql(SECTOR_EDITS.replace("from part", "from {part}"), part=m.table("part")), "product_id", "since")
    return as_of(lines, history, "product_id", "purchase_date").select("purchase_id", "line_number", "product_id", "line_cents", "purchase_date", "sector", "since", "until")
