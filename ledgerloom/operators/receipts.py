"""Receipts from their lines to the publish gate, and what is checked when a purchase or market is saved.

The lines of the driver's orders serve as receipts: each line's observed name is a variant of its part's name, the
catalog has one product for each distinct name. Distinct observed names are matched once, whatever the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import duck as D
from ..plans.model import CTES, Model
from ..plans.registry import Extended, Fixture, query
from .audit import AUDIT_SQL, LINE_SQL, audit_lines, audit_receipts
from .matching import _score_sql, decide_matches
from .scalars import score4

W = f"with {CTES} "


def catalog_products(m: Model) -> DataFrame:
    """One product for each distinct name of the part table; every third has a code."""
    one = m.products.groupBy("name").agg(F.min("product_id").alias("k"), F.min("brand").alias("brand"), F.min("category").alias("category"))
    none = F.lit(None).cast("string")
    return one.select(F.col("k").cast("string").alias("product_id"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("789"), F.col("k").cast("string"))).alias("barcode"), "name", F.lit(None).cast("array<string>").alias("aliases"), "brand", none.alias("pack"), F.lit("un").alias("unit"), "category")


def observed_name(name: Column, key: Column) -> Column:
    """The name as a receipt has it: as it is, in capitals, with a pack, or cut."""
    return F.when(key % 4 == 0, name).when(key % 4 == 1, F.upper(name)).when(key % 4 == 2, F.concat(name, F.lit(" 2L"))).otherwise(F.concat(F.substring(name, 1, 3), F.lit(". "), F.element_at(F.split(name, " "), -1)))


def observed_lines(m: Model) -> DataFrame:
    x = m.items.join(m.products.select("product_id", "name", "brand"), "product_id")
    money = lambda c, by: F.col(c).cast("double") / by
    return x.select(F.col("purchase_id").cast("string").alias("receipt_id"), F.col("line_number").cast("string").alias("line_id"), F.lit(None).cast("string").alias("barcode"), observed_name(F.col("name"), F.col("product_id")).alias("name"), "quantity", F.lit("un").alias("unit"), money("unit_price_e4", 10000).alias("unit_price"), money("line_cents", 100).alias("total"), F.lit(0.0).alias("discount"), F.lit(0.9).alias("confidence"))


def reconcile(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with match status, score and product of their names."""
    names = lines.select(F.col("name").alias("item_id")).distinct()
    none = F.lit(None).cast("string")
    items = names.select("item_id", none.alias("barcode"), F.col("item_id").alias("name"), none.alias("brand"), none.alias("pack"), F.lit("un").alias("unit"), none.alias("category"))
    found = decide_matches(items, products).select(F.col("item_id").alias("name"), F.col("status").alias("match_status"), F.col("score").alias("match_score"), F.col("product_id").alias("matched"))
    return lines.join(found, "name", "left")


OBSERVED = "case product_id % 4 when 0 then name when 1 then upper(name) when 2 then name || ' 2L' else substr(name, 1, 3) || '. ' || string_split(name, ' ')[-1] end"
MATCH_SQL = f"""p as (select cast(min(product_id) as varchar) as product_id, case when min(product_id) % 3 = 0 then '789' || min(product_id) end as barcode, name, cast(null as varchar[]) as aliases, min(brand) as brand, cast(null as varchar) as pack, 'un' as unit, min(category) as category from products group by name),
ol as (select i.purchase_id, i.line_number, i.product_id, {OBSERVED.replace('product_id', 'i.product_id')} as name, i.quantity, i.unit_price_e4, i.line_cents from items i join products p using (product_id)),
i as (select distinct name as item_id, cast(null as varchar) as barcode, name, cast(null as varchar) as brand, cast(null as varchar) as pack, 'un' as unit, cast(null as varchar) as category from ol),
{_score_sql()},
ranked as (select *, row_number() over w as rn, lead(score) over w as nx from scored where status <> 'CONFLICT' window w as (partition by item_id order by score desc, product_id)),
best as (select item_id, status, score, product_id, status <> 'EXACT' and nx is not null and score >= 0.6 and score - nx < 0.08 as ambiguous from ranked where rn = 1),
decided as (select i.item_id as name, case when coalesce(ambiguous, false) then 'AMBIGUOUS' else coalesce(status, 'NEW') end as match_status, {D.score4('coalesce(score, 0.0)')} as match_score, case when not coalesce(ambiguous, true) and status in ('EXACT', 'STRONG') then product_id end as matched from i left join best on i.item_id = best.item_id)"""


@query("reconcile_lines", f"{W}, {MATCH_SQL} select cast(purchase_id as varchar) as receipt_id, cast(line_number as varchar) as line_id, name, match_status, match_score, matched, match_status in ('AMBIGUOUS', 'REVIEW', 'WEAK') as needs_review from ol join decided using (name)")
def reconcile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    x = reconcile(observed_lines(m), catalog_products(m))
    return x.select("receipt_id", "line_id", "name", "match_status", "match_score", "matched", F.col("match_status").isin("AMBIGUOUS", "REVIEW", "WEAK").alias("needs_review"))


def receipt_headers(m: Model, lines: DataFrame) -> DataFrame:
    """Headers of the orders; of every third the total is that of its lines."""
    sums = lines.groupBy("receipt_id").agg(F.sum(F.floor(F.col("total") * 100 + 0.5)).alias("c"), F.count("*").cast("int").alias("n"))
    x = m.purchases.withColumn("receipt_id", F.col("purchase_id").cast("string")).join(sums, "receipt_id", "left")
    total = F.when(F.col("purchase_id") % 3 == 0, F.coalesce("c", F.lit(0))).otherwise(F.col("total_cents")).cast("double") / 100
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    return x.select("receipt_id", F.lit("Loja").alias("market"), F.col("market_id").cast("string").alias("cnpj"), F.col("purchase_date").cast("string").alias("date"), F.lit("10:00").alias("time"), total.alias("total"), zero.alias("discount_total"), zero.alias("surcharge"), F.coalesce("n", F.lit(0)).alias("declared"), none.alias("method"), F.lit(None).cast("double").alias("paid"), F.lit(None).cast("double").alias("change"), none.alias("fiscal_key"), F.lit("ocr").alias("source"), F.lit(0.9).alias("confidence"))


HEADER_SQL = """sums as (select purchase_id, sum(line_cents) as c, count(*) as n from ol group by 1),
r as (select cast(p.purchase_id as varchar) as receipt_id, 'Loja' as market, cast(market_id as varchar) as cnpj, cast(purchase_date as varchar) as date, '10:00' as time, cast(case when p.purchase_id % 3 = 0 then coalesce(c, 0) else total_cents end as double) / 100 as total, 0.0::double as discount_total, 0.0::double as surcharge, coalesce(n, 0)::int as declared,
 cast(null as varchar) as method, cast(null as double) as paid, cast(null as double) as change, cast(null as varchar) as fiscal_key, 'ocr' as source, 0.9::double as confidence from purchases p left join sums using (purchase_id)),
h as (select receipt_id as purchase_id, cnpj, date, case when cast(receipt_id as bigint) % 2 = 0 then '10:00' else '11:00' end as time, total + 0.03 as total, fiscal_key from r where cast(receipt_id as bigint) % 7 = 0),
l as (select cast(purchase_id as varchar) as receipt_id, cast(line_number as varchar) as line_id, cast(null as varchar) as barcode, name, quantity, 'un' as unit, cast(unit_price_e4 as double) / 10000 as unit_price, cast(line_cents as double) / 100 as total, 0.0::double as discount, match_status, 0.9::double as confidence from ol join decided using (name))"""
KINDS = ("EXACT", "STRONG", "AMBIGUOUS", "REVIEW", "WEAK", "NEW")


@query("receipt_end_to_end", f"""{W}, {MATCH_SQL}, {HEADER_SQL}, {LINE_SQL}, {AUDIT_SQL}, counted as (select receipt_id, {', '.join(f"count(*) filter (match_status = '{k}') as {k.lower()}" for k in KINDS)} from l group by 1)
select receipt_id, status, issues, warnings, coalesce(level, '') as duplicate, {', '.join(f'coalesce({k.lower()}, 0) as {k.lower()}' for k in KINDS)}, case when n = 0 then 'NO_ITEMS' when status <> 'PASS' then 'NOT_PASSED' when coalesce(total, 0) <= 0 then 'NO_TOTAL' else 'OK' end as gate from receipts_audited left join counted using (receipt_id)""")
def receipt_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines matched with the catalog, audited, held against earlier purchases, and the gate's decision."""
    m = Model(spark, sf_dir)
    observed = observed_lines(m)
    lines = reconcile(observed, catalog_products(m))
    headers = receipt_headers(m, observed)
    number = F.col("receipt_id").cast("long")
    history = headers.where(number % 7 == 0).select(F.col("receipt_id").alias("purchase_id"), "cnpj", "date", F.when(number % 2 == 0, "10:00").otherwise("11:00").alias("time"), (F.col("total") + 0.03).alias("total"), "fiscal_key")
    counts = lines.groupBy("receipt_id").agg(*(F.count_if(F.col("match_status") == k).alias(k.lower()) for k in KINDS))
    x = audit_receipts(headers, audit_lines(lines.drop("match_score", "matched")), history).join(counts, "receipt_id", "left")
    gate = F.when(F.col("lines") == 0, "NO_ITEMS").when(F.col("status") != "PASS", "NOT_PASSED").when(F.coalesce("total", F.lit(0.0)) <= 0, "NO_TOTAL").otherwise("OK")
    return x.select("receipt_id", "status", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), F.coalesce("level", F.lit("")).alias("duplicate"), *(F.coalesce(k.lower(), F.lit(0)).alias(k.lower()) for k in KINDS), gate.alias("gate"))


@query("find_existing_product", f"{W}, {MATCH_SQL} select item_id as name, case when score >= 0.74 and not ambiguous and status in ('EXACT', 'STRONG') then product_id end as product_id from i left join best using (item_id)")
def find_existing_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product that a new line joins when it is saved: matched, alone, and with a score of .74 or more."""
    m = Model(spark, sf_dir)
    x = reconcile(observed_lines(m).select("name").distinct(), catalog_products(m))
    return x.select("name", F.when(F.col("match_score") >= 0.74, F.col("matched")).alias("product_id"))


#: Weight of a source, a fixed value of the domain.
SOURCE_WEIGHTS = {"fiscal_xml": 1.0, "fiscal_json": 0.99, "fiscal_pdf": 0.98, "qr": 0.97, "manual": 1.0, "vision": 0.9, "catalog": 0.88, "tesseract": 0.75, "ocr": 0.72, "ocr_space": 0.7, "unknown": 0.25}


def source_weight(source: Column) -> Column:
    name = F.replace(S.normalize_receipt(source), F.lit(" "), F.lit("_"))
    return F.coalesce(*(F.when(name == k, w) for k, w in SOURCE_WEIGHTS.items()), F.lit(SOURCE_WEIGHTS["unknown"]))


SOURCES = "case event_id % 5 when 0 then 'Fiscal XML' when 1 then 'ocr' when 2 then 'OCR Space' when 3 then event_type else null end"


@query("source_weights", f"with s as (select event_id, {SOURCES} as source from events) select event_id, case replace({D.norm_receipt('source')}, ' ', '_') {' '.join(f"when '{k}' then {w}::double" for k, w in SOURCE_WEIGHTS.items())} else 0.25::double end as weight from s")
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Model(spark, sf_dir).table("events")
    return e.select("event_id", source_weight(F.expr(SOURCES)).alias("weight"))


@query("match_evidence", f"""{W}, {MATCH_SQL} select name, case when matched is null then 'MISSING' when match_status = 'AMBIGUOUS' then 'CONFLICT' when c >= 0.8 then 'CONFIRMED' when c >= 0.55 then 'INFERRED' else 'UNCERTAIN' end as status, c as confidence, match_status in ('AMBIGUOUS', 'REVIEW', 'WEAK') as rejected
from (select *, case match_status when 'NEW' then 0.75::double else least(1.0::double, match_score) end as c from decided)""")
def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a line's product: none without a product, a conflict if another one is as near."""
    m = Model(spark, sf_dir)
    x = reconcile(observed_lines(m).select("name").distinct(), catalog_products(m))
    c = F.when(F.col("match_status") == "NEW", 0.75).otherwise(F.least(F.lit(1.0), F.col("match_score")))
    status = F.when(F.col("matched").isNull(), "MISSING").when(F.col("match_status") == "AMBIGUOUS", "CONFLICT").when(c >= 0.8, "CONFIRMED").when(c >= 0.55, "INFERRED").otherwise("UNCERTAIN")
    return x.select("name", status.alias("status"), c.alias("confidence"), F.col("match_status").isin("AMBIGUOUS", "REVIEW", "WEAK").alias("rejected"))


#: Purchases and copies of every fiftieth, 0 to 10 cents dearer, so that there are duplicates to find.
COPIES = 1_000_000_000
PLANTED_SQL = f"planted as (select purchase_id, market_id, purchase_date, total_cents, active from purchases union all select purchase_id + {COPIES}, market_id, purchase_date, total_cents + purchase_id % 11, active from purchases where purchase_id % 50 = 0)"


def planted_purchases(m: Model) -> DataFrame:
    p = m.purchases.select("purchase_id", "market_id", "purchase_date", "total_cents", "active")
    copies = p.where("purchase_id % 50 = 0").select((F.col("purchase_id") + COPIES).alias("purchase_id"), "market_id", "purchase_date", (F.col("total_cents") + F.col("purchase_id") % 11).alias("total_cents"), "active")
    return p.unionByName(copies)


@query("duplicate_candidates", f"{W}, {PLANTED_SQL} select a.purchase_id as first, b.purchase_id as second, cast(a.total_cents - b.total_cents as double) / 100 as delta from planted a join planted b on a.market_id = b.market_id and a.purchase_date = b.purchase_date and a.purchase_id < b.purchase_id where abs(a.total_cents - b.total_cents) <= 5")
def duplicate_candidates(spark: SparkSession, sf_dir: str, band_cents: int = 5) -> DataFrame:
    """Pairs of purchases of one market and day whose totals differ by at most the band.

    The band is part of the join's key: each total meets the totals of its own and the two neighbouring
    bands, so a busy market's day makes no pairs beyond them.
    """
    p = planted_purchases(Model(spark, sf_dir)).select("purchase_id", "market_id", "purchase_date", "total_cents").withColumn("band", F.floor(F.col("total_cents") / (band_cents + 1)))
    a = p.select(F.col("purchase_id").alias("first"), "market_id", "purchase_date", "total_cents", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    b = p.select(F.col("purchase_id").alias("second"), "market_id", "purchase_date", "band", F.col("total_cents").alias("other"))
    pairs = a.join(b, ["market_id", "purchase_date", "band"]).where((F.col("first") < F.col("second")) & (F.abs(F.col("total_cents") - F.col("other")) <= band_cents))
    return pairs.select("first", "second", ((F.col("total_cents") - F.col("other")).cast("double") / 100).alias("delta"))


SEEN_ONLINE = "select case when c_custkey % 3 = 0 then upper(c_name) when c_custkey % 3 = 1 then c_name || ' Novo' else c_name end as name, case when c_custkey % 2 = 0 then n_name else '' end as neighborhood, c_custkey as seq from customer join nation on c_nationkey = n_nationkey"


@query("include_online_market", f"with f as ({SEEN_ONLINE}), x as (select *, {D.norm('name')} as n, {D.norm('neighborhood')} as b from f), m as (select {D.norm('c_name')} as n, {D.norm('n_name')} as b from customer join nation on c_nationkey = n_nationkey) select seq, name, n <> '' and not exists (select 1 from m where m.n = x.n and (x.b = '' or m.b = x.b)) as included from x")
def include_online_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found markets that aren't known: by name, and by neighborhood where the find has one."""
    m = Model(spark, sf_dir)
    k = F.col("market_id")
    found = m.markets.select(F.when(k % 3 == 0, F.upper("name")).when(k % 3 == 1, F.concat("name", F.lit(" Novo"))).otherwise(F.col("name")).alias("name"), F.when(k % 2 == 0, F.col("neighborhood")).otherwise("").alias("neighborhood"), k.alias("seq"))
    x = found.select("seq", "name", S.normalize(F.col("name")).alias("n"), S.normalize(F.col("neighborhood")).alias("b"))
    known = m.markets.select(S.normalize(F.col("name")).alias("n"), S.normalize(F.col("neighborhood")).alias("b"))
    # one equi-join: an empty neighborhood stands for any
    keys = known.unionByName(known.withColumn("b", F.lit(""))).distinct().withColumn("known", F.lit(True))
    return x.join(keys, ["n", "b"], "left").select("seq", "name", ((F.col("n") != "") & F.col("known").isNull()).alias("included"))


@query("distinct_neighborhoods", W + "select distinct neighborhood from markets where coalesce(neighborhood, '') <> ''")
def distinct_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).markets.where("coalesce(neighborhood, '') <> ''").select("neighborhood").distinct()


@query("distinct_sectors", W + "select distinct coalesce(sector_snapshot, category) as sector from items join products using (product_id) where coalesce(sector_snapshot, category, '') <> ''")
def distinct_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of the lines, or else their products' categories."""
    m = Model(spark, sf_dir)
    pairs = m.items.select("sector_snapshot", "product_id").distinct().join(m.products.select("product_id", "category"), "product_id")
    return pairs.select(F.coalesce("sector_snapshot", "category").alias("sector")).where("coalesce(sector, '') <> ''").distinct()


@query("neighborhood_markets", W + "select neighborhood, string_agg(name, '|' order by name) as names from (select distinct coalesce(neighborhood, 'Bairro não informado') as neighborhood, name from markets where active) group by 1")
def neighborhood_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each neighborhood's active markets; a row holds one neighborhood's list."""
    x = Model(spark, sf_dir).markets.where("active").select(F.coalesce("neighborhood", F.lit("Bairro não informado")).alias("neighborhood"), "name")
    return x.groupBy("neighborhood").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


@query("report_by_category", W + "select coalesce(category, 'Outros') as category, cast(sum(net_cents) as double) / 100 as total, count(*) as lines from active_items left join products using (product_id) group by 1")
def report_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    x = m.active_items.join(m.products.select("product_id", "category"), "product_id", "left")
    return x.groupBy(F.coalesce("category", F.lit("Outros")).alias("category")).agg((F.sum("net_cents").cast("double") / 100).alias("total"), F.count("*").alias("lines"))


def money_text(cents: Column) -> Column:
    """Whole cents as pt-BR writes them: R$, a no-break space, dots for thousands, a comma."""
    size = F.abs(cents)
    whole = F.replace(F.format_number(F.floor(size / 100), 0), F.lit(","), F.lit("."))
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("R$ "), whole, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"))


def quantity_text(thousandths: Column) -> Column:
    """A whole quantity as it is, else three decimals after a comma."""
    return F.when(thousandths % 1000 == 0, (thousandths / 1000).cast("long").cast("string")).otherwise(F.concat(F.floor(thousandths / 1000).cast("string"), F.lit(","), F.lpad((thousandths % 1000).cast("string"), 3, "0")))


@query("display_amounts", W + "select purchase_id, line_number, product_id, case when v < 0 then '-' else '' end || 'R$ ' || replace(format('{:,}', abs(v) // 100), ',', '.') || ',' || lpad(cast(abs(v) % 100 as varchar), 2, '0') as amount, case when q % 1000 = 0 then cast(q // 1000 as varchar) else cast(q // 1000 as varchar) || ',' || lpad(cast(q % 1000 as varchar), 3, '0') end as quantity from (select *, line_cents - 3 * discount_cents * 4 as v, quantity_e3 + line_number * 125 as q from items)")
def display_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Model(spark, sf_dir).items
    return x.select("purchase_id", "line_number", "product_id", money_text(F.col("line_cents") - 12 * F.col("discount_cents")).alias("amount"), quantity_text(F.col("quantity_e3") + F.col("line_number") * 125).alias("quantity"))


def text_signature(c: Column) -> Column:
    """The first 240 characters in capitals, white space as single blanks."""
    return F.substring(F.trim(F.regexp_replace(F.upper(S.blank(c)), r"\s+", " ")), 1, 240)


@query("text_signature", "select doc_id, left(trim(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '\\s+', ' ', 'g')), 240) as signature from documents")
def text_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).table("documents").select("doc_id", text_signature(F.col("text")).alias("signature"))


def file_stem(c: Column) -> Column:
    """A name that file systems take, of at most 80 characters."""
    name = F.when(S.blank(c) == "", "documento-fiscal").otherwise(S.blank(c))
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 80)


@query("safe_file_stem", "select page_id, left(regexp_replace(case when coalesce(url, '') = '' then 'documento-fiscal' else url end, '[^A-Za-z0-9._-]+', '_', 'g'), 80) as stem from pages")
def safe_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).table("pages").select("page_id", file_stem(F.col("url")).alias("stem"))


def loose_date(c: Column) -> Column:
    """dd/mm/yyyy or dd-mm-yy (years of this century) as an ISO date's text, else an ISO date in the text, else empty."""
    part = lambda i: F.regexp_extract(S.blank(c), r"(\d{2})[/-](\d{2})[/-](\d{2,4})", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.when(part(1) != "", F.concat_ws("-", year, part(2), part(1))).otherwise(F.regexp_extract(S.blank(c), r"(\d{4}-\d{2}-\d{2})", 1))


WRITTEN = "case purchase_id % 4 when 0 then 'Em ' || {dmy} when 1 then {dm2} || ' 10:00' when 2 then 'T' || {iso} || 'T10:00' else 'sem data' end"


@query("parse_date_loose", W + ", w as (select purchase_id, purchase_date as d from purchases) select purchase_id, case purchase_id % 4 when 0 then strftime(d, '%Y-%m-%d') when 1 then '20' || strftime(d, '%y-%m-%d') when 2 then '20' || strftime(d, '%d-%m-%y') else '' end as date from w")
def parse_date_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways and read again; the SQL gives what must come out, without reading texts.

    The day-first pattern goes before the ISO one and finds itself in ISO dates (97-08-16 in 1997-08-16), as the domain has it.
    """
    p = Model(spark, sf_dir).purchases
    as_text = lambda f: f"date_format(purchase_date, '{f}')"
    written = WRITTEN.format(dmy=as_text("dd/MM/yyyy"), dm2=as_text("dd-MM-yy"), iso=as_text("yyyy-MM-dd"))
    return p.select("purchase_id", loose_date(F.expr(written)).alias("date"))


@query("guess_pack", "select p_partkey as product_id, case p_partkey % 3 when 0 then cast(p_size as varchar) || ' KG' when 1 then cast(p_size as varchar) || '.5 ML' else '' end as pack from part")
def guess_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number and unit of a name, in capitals; the SQL gives the pack that went in."""
    size = F.col("p_size").cast("string")
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), size, F.lit("kg"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" pote "), size, F.lit(",5 ml")).cast("string")).otherwise(" 12 mg"))
    return Model(spark, sf_dir).table("part").select(F.col("p_partkey").alias("product_id"), S.guess_pack(name).alias("pack"))


SEED = Fixture("purchase_id long, total_cents long", [(-1, 35001), (-2, 9551)])


def seed_if_empty(store: DataFrame, seed: DataFrame) -> DataFrame:
    """The store, or the seed where it has no row."""
    none = store.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("x"))  # one row or none
    return store.unionByName(seed.join(F.broadcast(none)).drop("x"))


@query("seed_if_empty", f"{W}, {SEED.cte('s')}, all_rows as (select purchase_id, total_cents from purchases), none as (select * from all_rows where purchase_id < 0) select 'full' as store, purchase_id, total_cents from all_rows union all select 'empty', purchase_id, total_cents from s where not exists (select 1 from none)")
def seed_if_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, seed = Model(spark, sf_dir).purchases.select("purchase_id", "total_cents"), SEED.df(spark)
    full = seed_if_empty(p, seed).select(F.lit("full").alias("store"), "purchase_id", "total_cents")
    return full.unionByName(seed_if_empty(p.where("purchase_id < 0"), seed).select(F.lit("empty").alias("store"), "purchase_id", "total_cents"))


@query("migrate_lists", "select user_id as list_id, event_id as entry, false as checked, greatest(0.001::double, case when value = 0 or event_type = 'view' then 1.0::double else value end) as qty, true as active from events")
def migrate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of old lists: nothing is checked, a missing quantity is one, none is under .001, a missing flag means active."""
    e = Model(spark, sf_dir).table("events").withColumn("qty", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value")))
    qty = F.coalesce(F.col("qty").cast("double"), F.lit(0.0))
    return e.select(F.col("user_id").alias("list_id"), F.col("event_id").alias("entry"), F.lit(False).alias("checked"), F.greatest(F.lit(0.001), F.when(qty == 0, 1.0).otherwise(qty)).alias("qty"), F.lit(True).alias("active"))


@query("migrate_snapshots", W + "select purchase_id, line_number, product_id, case when sector_snapshot = 'N' then coalesce(category, 'Outros') else sector_snapshot end as sector, case when health_snapshot = 'O' then 'Não classificado' else health_snapshot end as health from items left join products using (product_id)")
def migrate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a snapshot take their product's sector; those that have one keep it (N and O stand for none)."""
    m = Model(spark, sf_dir)
    x = m.items.join(m.products.select("product_id", "category"), "product_id", "left")
    none = lambda c, mark: F.when(F.col(c) != mark, F.col(c))
    return x.select("purchase_id", "line_number", "product_id", F.coalesce(none("sector_snapshot", "N"), "category", F.lit("Outros")).alias("sector"), F.coalesce(none("health_snapshot", "O"), F.lit("Não classificado")).alias("health"))


READ = Extended(
    "receipt_id string, seq long, name string, cnpj string, date string, total string, items int, sure int, priced int, declared int", [("a", 1, "Loja", "17833301002223", "2026-01-01", "10.00", 4, 4, 4, 5), ("a", 2, "Loja", "", "2026-01-02", "12.00", 0, 0, 0, 0), ("a", 3, "Laja", "17833301002223", "2026-01-01", "12.00", 0, 0, 0, 0), ("b", 1, None, None, None, None, 0, 0, 0, 0), ("c", 1, "Z", "1", "", "3.00", 2, 1, 2, 0), ("c", 2, "Y", "2", "2026-02-02", "3.00", 0, 0, 0, 0)],
    "select 'o' || o_orderkey as receipt_id, 1 as seq, 'Loja ' || o_custkey as name, case when o_orderkey % 5 = 0 then '' else lpad(cast(o_custkey as varchar(20)), 14, '0') end as cnpj, cast(cast(o_orderdate as date) as varchar(20)) as date, cast(o_totalprice as varchar(30)) as total, 3 + o_orderkey % 4 as items, o_orderkey % 3 as sure, o_orderkey % 4 as priced, o_orderkey % 6 as declared from {orders} union all select 'o' || o_orderkey as receipt_id, 2 as seq, case when o_orderkey % 2 = 0 then 'Laja ' || o_custkey else 'Loja ' || o_custkey end as name, '1' as cnpj, cast(cast(o_orderdate as date) as varchar(20)) as date, case when o_orderkey % 3 = 0 then '1.00' else cast(o_totalprice as varchar(30)) end as total, 3 as items, o_orderkey % 3 as sure, o_orderkey % 4 as priced, o_orderkey % 6 as declared from {orders} union all select 'o' || o_orderkey as receipt_id, 3 as seq, 'Laja ' || o_custkey as name, '1' as cnpj, cast(cast(o_orderdate as date) as varchar(20)) as date, case when o_orderkey % 3 = 0 then '1.00' else cast(o_totalprice as varchar(30)) end as total, 0 as items, o_orderkey % 3 as sure, o_orderkey % 4 as priced, o_orderkey % 6 as declared from {orders}",
)


@query("consensus_header", f"with {READ.cte('t')}, v as (select receipt_id, seq, unnest(['name', 'cnpj', 'date', 'total']) as field, unnest([name, cnpj, date, total]) as value from t), c as (select receipt_id, field, value, count(*) as votes, min(seq) as first from v where coalesce(value, '') <> '' group by 1, 2, 3), w as (select receipt_id, field, value from (select *, row_number() over (partition by receipt_id, field order by votes desc, first) as r from c) where r = 1), h as (select receipt_id, max(value) filter (field = 'name') as name, max(value) filter (field = 'cnpj') as cnpj, max(value) filter (field = 'date') as date, max(value) filter (field = 'total') as total from w group by 1), s as (select receipt_id, sum(items) as n, sum(sure) as k, sum(priced) as p, max(declared) as d from t group by 1) select receipt_id, coalesce(name, 'Mercado não identificado') as name, coalesce(cnpj, '') as cnpj, coalesce(date, '') as date, coalesce(cast(total as double), 0) as total, {D.score4('least(1.0::double, 0.35::double * (case when n = 0 then 0 else k::double / n end) + 0.25::double * least(1.0::double, p::double / greatest(1, case when d > 0 then d else n end)) + case when coalesce(cnpj, %s) <> %s then 0.2::double else 0 end + case when date is not null and coalesce(cast(total as double), 0) <> 0 then 0.2::double else 0 end)' % (D.q(''), D.q('')))} as confidence from s left join h using (receipt_id)")
def consensus_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on name, tax number, date and total, and the confidence: .35 sure lines, .25 coverage, .20 tax number, .20 date and total."""
    t = READ.df(spark, sf_dir)
    fields = ("name", "cnpj", "date", "total")
    votes = t.select("receipt_id", "seq", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("v")).select("receipt_id", "seq", "v.*").where("coalesce(value, '') <> ''")
    counted = votes.groupBy("receipt_id", "field", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = counted.groupBy("receipt_id", "field").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    header = best.groupBy("receipt_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    sums = t.groupBy("receipt_id").agg(F.sum("items").alias("n"), F.sum("sure").alias("k"), F.sum("priced").alias("p"), F.max("declared").alias("d"))
    x = sums.join(header, "receipt_id", "left").withColumn("total", F.coalesce(F.col("total").cast("double"), F.lit(0.0)))
    sure = F.when(F.col("n") == 0, 0.0).otherwise(F.col("k") / F.col("n"))
    cover = F.least(F.lit(1.0), F.col("p") / F.greatest(F.lit(1), F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("n"))))
    flag = lambda c: F.when(c, 0.2).otherwise(0.0)
    c = F.least(F.lit(1.0), 0.35 * sure + 0.25 * cover + flag(S.blank(F.col("cnpj")) != "") + flag(F.col("date").isNotNull() & (F.col("total") != 0)))
    return x.select("receipt_id", F.coalesce("name", F.lit("Mercado não identificado")).alias("name"), S.blank(F.col("cnpj")).alias("cnpj"), S.blank(F.col("date")).alias("date"), "total", score4(c).alias("confidence"))


@query("display_dates", W + "select purchase_id, case when purchase_id % 10 = 0 then '—' else lpad(cast(day(purchase_date) as varchar), 2, '0') || '/' || lpad(cast(month(purchase_date) as varchar), 2, '0') || '/' || year(purchase_date) end as shown from purchases")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as pt-BR writes them, a dash for none (here: every tenth)."""
    day = F.when(F.col("purchase_id") % 10 != 0, F.col("purchase_date"))
    return Model(spark, sf_dir).purchases.select("purchase_id", F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit("—")).alias("shown"))


@query("vision_total", W + ", t as (select purchase_id, total_cents as l, case purchase_id % 4 when 0 then 0 when 1 then total_cents + 5 when 2 then total_cents - 6 else total_cents end as v from purchases) select purchase_id, cast(case when v = 0 then l when l = 0 then v when abs(v - l) > 5 then l else v end as double) / 100 as total, v <> 0 and l <> 0 and abs(v - l) > 5 as needs_review from t")
def vision_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of a receipt read twice: the second reading's, but the first's, for review, where they differ by more than 5 cents."""
    k, first = F.col("purchase_id") % 4, F.col("total_cents")
    second = F.when(k == 0, F.lit(0)).when(k == 1, first + 5).when(k == 2, first - 6).otherwise(first)
    apart = (second != 0) & (first != 0) & (F.abs(second - first) > 5)
    total = F.when(apart | (second == 0), first).otherwise(second)
    return Model(spark, sf_dir).purchases.select("purchase_id", (total.cast("double") / 100).alias("total"), apart.alias("needs_review"))


#: Settings that are never kept, fixed values of the domain.
SECRET_SETTINGS = ("geminiApiKey", "allowDirectGeminiKey")
SETTINGS = Extended(
    "name string, value string", [("geminiModel", "m"), ("geminiApiKey", "k"), ("healthEnabled", "true"), ("allowDirectGeminiKey", "true")],
    "select r_name as name, 'v' || r_regionkey as value from {region}",
)


@query("settings_scrub", f"with {SETTINGS.cte('s')} select name, value from s where name not in ('geminiApiKey', 'allowDirectGeminiKey')")
def settings_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings without those that hold keys."""
    return SETTINGS.df(spark, sf_dir).where(~F.col("name").isin(*SECRET_SETTINGS))


# Fixed values of the domain: what stands before a field on a public receipt page, and the field's form.
PAGE_FIELDS = {
    "cnpj": r"\bCNPJ\D{0,30}(\d{2}[. ]?\d{3}[. ]?\d{3}[/ ]?\d{4}[- ]?\d{2})",
    "market": r"(?:Raz[aã]o Social|Nome/Raz[aã]o Social|Emitente|Estabelecimento)\D{0,5}([A-ZÀ-Ú0-9][^|]{3,100}?)\s+(?:CNPJ|CPF|Endere[cç]o|Data|Valor|Total)\b",
    "date": r"(?:Data(?: de emiss[aã]o)?|Emiss[aã]o)\D{0,12}(\d{2}[/-]\d{2}[/-]\d{2,4})",
    "time": r"(?:Hora|Hor[aá]rio)\D{0,8}(\d{2}:\d{2}(?::\d{2})?)",
    "total": r"(?:Valor\s+a\s+pagar|Valor\s+total|Total\s+da\s+nota|Total)\D{0,12}((?:R\$\s*)?[\d.]+,\d{2})",
    "discount": r"(?:Desconto|Descontos)\D{0,12}((?:R\$\s*)?[\d.]+,\d{2})",
    "document": r"(?:NFC-e|Nota Fiscal de Consumidor).{0,80}?(?:N[ºo°]?|Número|Numero)\D{0,8}(\d{1,12})",
    "payment": r"(?:Forma de pagamento|Pagamento|Meio de pagamento)\D{0,20}([A-Za-zÀ-Ú ]{3,40})",
}
HEAD_PAGES = Fixture("page_id long, html string", [(-1, "<b>Razão Social:</b> MERCADO BOM LTDA CNPJ: 17.833.301/0022-23 Data de Emissão: 10-09-26 Hora: 14:25:01 <i>Valor total R$ 1.018,00</i> Descontos: 2,50 NFC-e série 1 número 000123 Forma de pagamento: Pix"), (-2, "EMITENTE: Loja Única TOTAL 9,90 horário 08:15"), (-3, None)])


@query("html_receipt_header", f"""with {HEAD_PAGES.cte('f')}, p as (select * from f union all select page_id, html from pages), t as (select page_id, {D.html_text('html')} as x from p), e as (select page_id, {', '.join(f"regexp_extract(x, {D.q(p)}, 1, 'i') as {c}" for c, p in PAGE_FIELDS.items())} from t)
select page_id, {D.digits('cnpj')} as cnpj, trim(market) as market, case when date = '' then '' else (case when length(date) = 8 then '20' || substr(date, 7) else substr(date, 7) end) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) end as date, time, {D.parse_number('total', 'loose')} as total, {D.parse_number('discount', 'loose')} as discount, document, trim(payment) as payment from e""")
def html_receipt_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of public receipt pages; empty or 0 where a page has none."""
    pages = HEAD_PAGES.df(spark).unionByName(Model(spark, sf_dir).table("pages").select("page_id", "html"))
    x = pages.select("page_id", S.html_to_text(F.col("html")).alias("x"))
    x = x.select("page_id", *(F.regexp_extract("x", "(?iu)" + p, 1).alias(c) for c, p in PAGE_FIELDS.items()))
    amount = lambda c: S.parse_number(F.col(c), "loose").alias(c)
    return x.select("page_id", S.digits(F.col("cnpj")).alias("cnpj"), F.trim("market").alias("market"), loose_date(F.col("date")).alias("date"), "time", amount("total"), amount("discount"), "document", F.trim("payment").alias("payment"))
