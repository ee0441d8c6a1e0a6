"""Receipt audit: line arithmetic, document reconciliation, duplicates, field evidence and the publish gate.

Money is summed as whole cents, so sums don't depend on the order of rows. Issues and warnings are codes.
Line tolerance is 0.03, document tolerance 0.05. A duplicate without a fiscal key needs a tax number;
line status is PASS or BLOCK only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..plans import duck as D
from ..plans.model import CTES, Model
from ..plans.registry import Extended, Fixture, query

LINE_TOLERANCE, DOCUMENT_TOLERANCE = 0.03, 0.05
UNITS = sorted(set(V.UNIT_ALIASES.values()))


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5)


def audit_lines(lines: DataFrame) -> DataFrame:
    """Adds the audit of each line to rows of name, quantity, unit, unit_price, total and discount."""
    x = lines.withColumn("unit", S.canonical_unit(F.col("unit"))).withColumn("discount", F.greatest(F.lit(0.0), F.coalesce("discount", F.lit(0.0))))
    x = x.withColumn("gross", S.round2(F.col("quantity") * F.col("unit_price")))
    x = x.withColumn("net", S.round2(F.col("gross") - F.col("discount")))
    both, off = F.col("gross").isNotNull() & F.col("total").isNotNull(), F.col("discount") > 0
    net_delta, gross_delta = S.round2(F.col("total") - F.col("net")), S.round2(F.col("total") - F.col("gross"))
    is_net, is_gross = off & (F.abs(net_delta) <= LINE_TOLERANCE), F.abs(gross_delta) <= LINE_TOLERANCE
    basis = F.when(both & is_net, "NET_AFTER_DISCOUNT").when(both & is_gross & off, "GROSS_BEFORE_DISCOUNT").when(both & is_gross, "GROSS_EQ_NET").otherwise("UNRESOLVED")
    delta = F.when(both & ~is_net & is_gross, gross_delta).when(both, net_delta)
    known = F.col("unit").isin(UNITS)
    arithmetic = both & ((off & (F.abs(F.col("total") - (F.col("gross") - F.col("discount"))) <= LINE_TOLERANCE)) | (F.abs(F.col("total") - F.col("gross")) <= LINE_TOLERANCE))
    fair = F.coalesce(F.col("discount") <= F.col("gross") + LINE_TOLERANCE, F.lit(False))
    wants = [("nome", F.length(F.trim(S.blank(F.col("name")))) >= 2), ("quantidade", F.col("quantity") > 0), ("unidade", known), ("preço unitário", F.col("unit_price") >= 0), ("total da linha", F.col("total") >= 0)]
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in wants)))
    x = x.withColumn("basis", basis).withColumn("expected_net", F.when(both, F.col("net"))).withColumn("delta", delta).withColumn("missing", missing)
    x = x.withColumn("arithmetic", F.coalesce(arithmetic, F.lit(False))).withColumn("fair", fair).withColumn("weighted", F.col("unit").isin("kg", "g", "l", "ml"))
    return x.withColumn("status", F.when((F.size("missing") > 0) | ~F.col("arithmetic") | ~F.col("fair") | ~known, "BLOCK").otherwise("PASS"))


LINES = Fixture(
    "receipt_id string, line_id string, barcode string, name string, quantity double, unit string, unit_price double, total double, discount double, match_status string, confidence double",
    [
        *[("R1", f"ITEM-00{i + 1}", "789", f"item {i}", q, "un", u, t, 0.0, "EXACT", 0.9) for i, (q, u, t) in enumerate([(1.0, 10.49, 10.49), (2.0, 0.14, 0.28), (1.0, 9.29, 9.29), (3.0, 5.99, 17.97), (1.0, 57.48, 57.48)])],
        *[("R1-total", f"ITEM-00{i + 1}", "789", f"item {i}", q, "UND", u, t, None, "EXACT", 0.9) for i, (q, u, t) in enumerate([(1.0, 10.49, 10.49), (2.0, 0.14, 0.28)])],
        ("R1-line", "ITEM-001", None, "item", 3.0, "un", 5.99, 15.0, 0.0, "NEW", 0.9),
        ("L-weight", "ITEM-001", None, "queijo", 0.236, "kg", 26.98, 6.37, 0.0, "STRONG", 0.9),
        ("L-missing", "ITEM-001", None, "pão", 1.0, "un", None, 5.0, 0.0, "NEW", 0.9),
        ("R-net", "ITEM-001", "111", "papel", 2.0, "un", 14.9, 27.8, 2.0, "EXACT", 0.9),
        ("R-gross", "ITEM-001", "111", "papel", 2.0, "un", 14.9, 29.8, 2.0, "EXACT", 0.9),
        ("R-review", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "REVIEW", 0.7),
        ("R-manual", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "MANUAL", 1.0),
        ("R-bad", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-edge", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.03, 0.0, "EXACT", 0.9),
        ("R-edge", "ITEM-002", "112", "x", 1.0, "caixote", 10.0, 10.04, 11.0, "WEAK", 0.5),
        ("R-cash", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-cash-bad", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-fee", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-count", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-dup-key", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-dup-ctx", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-dup-one", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
        ("R-dup-many", "ITEM-001", "111", "papel", 1.0, "un", 10.0, 10.0, 0.0, "EXACT", 0.9),
    ],
)
KEY = "35160917833301002223650010003839831012345676"
HEADERS = Fixture(
    "receipt_id string, market string, cnpj string, date string, time string, total double, discount_total double, surcharge double, declared int, method string, paid double, change double, fiscal_key string, source string, confidence double",
    [
        ("R1", "Loja", "17.833.301/0022-23", "2026-09-10", "10:00", 95.51, None, None, 5, "pix", 95.51, None, None, "manual", 0.9),
        ("R1-total", "Loja", "1", "2026-09-11", "10:00", 11.77, 0.0, 0.0, 2, "pix", None, None, None, "ocr", 0.9),
        ("R1-line", "Loja", "1", "2026-09-12", "10:00", 15.0, 0.0, 0.0, 1, None, None, None, None, "ocr", 0.6),
        ("L-weight", "Loja", "1", "2026-09-13", "10:00", 6.37, 0.0, 0.0, None, None, None, None, None, "fiscal xml", 1.0),
        ("L-missing", "Loja", "1", "2026-09-14", "10:00", 5.0, 0.0, 0.0, None, None, None, None, None, "ocr", 0.9),
        ("R-net", "Loja", "1", "2026-09-15", "10:00", 27.8, 2.0, 0.0, 1, None, None, None, None, "qr", 0.9),
        ("R-gross", "Loja", "1", "2026-09-16", "10:00", 27.8, 2.0, 0.0, 1, None, None, None, None, "qr", 0.9),
        ("R-review", "Loja", "1", "2026-09-17", "10:00", 10.0, 0.0, 0.0, 1, None, None, None, None, "vision", 0.9),
        ("R-manual", "Loja", "1", "2026-09-18", "10:00", 10.0, 0.0, 0.0, 1, None, None, None, None, "vision", 0.9),
        ("R-bad", "Loja", "1", "2026-09-19", "10:00", 12.0, 0.0, 0.0, 1, None, None, None, None, "ocr", 0.5),
        ("R-edge", "", "1", None, "10:00", None, 30.0, 0.0, 3, None, None, None, None, "strange", 0.9),
        ("R-cash", "Loja", "1", "2026-09-20", "10:00", 10.0, 0.0, 0.0, 1, "Dinheiro", 50.0, 40.0, None, "ocr", 0.9),
        ("R-cash-bad", "Loja", "1", "2026-09-21", "10:00", 10.0, 0.0, 0.0, 1, "Dinheiro", 50.0, 30.0, None, "ocr", 0.9),
        ("R-fee", "Loja", "1", "2026-09-22", "10:00", 11.0, 0.0, 1.0, 1, "pix", 11.0, None, None, "ocr", 0.9),
        ("R-count", "Loja", "1", "2026-09-23", "10:00", 10.0, 0.0, 0.0, 4, "pix", 9.0, None, None, "ocr", 0.9),
        ("R-dup-key", "Loja", "1", "2026-09-24", "10:00", 10.0, 0.0, 0.0, 1, None, None, None, KEY, "ocr", 0.9),
        ("R-dup-ctx", "Loja", "22", "2026-09-25", "10:00:30", 10.0, 0.0, 0.0, 1, None, None, None, None, "ocr", 0.9),
        ("R-dup-one", "Loja", "22", "2026-09-26", "10:00", 10.0, 0.0, 0.0, 1, None, None, None, None, "ocr", 0.9),
        ("R-dup-many", "Loja", "22", "2026-09-27", "10:00", 10.0, 0.0, 0.0, 1, None, None, None, None, "ocr", 0.9),
        ("R-empty", "Loja", "1", "2026-09-28", "10:00", 10.0, 0.0, 0.0, 0, None, None, None, None, "ocr", 0.9),
    ],
)
HISTORY = Fixture(
    "purchase_id string, cnpj string, date string, time string, total double, fiscal_key string",
    [
        ("h1", "9", "2026-01-01", "09:00", 1.0, "3516 0917 8333 0100 2223 6500 1000 3839 8310 1234 5676"),
        ("h2", "2-2", "2026-09-25", "10:00:30", 10.04, None),
        ("h3", "22", "2026-09-25", "11:00:00", 10.0, None),
        ("h4", "22", "2026-09-26", "12:00", 9.96, None),
        ("h5", "22", "2026-09-27", "12:00", 10.0, None),
        ("h6", "22", "2026-09-27", "13:00", 10.0, None),
        ("h7", None, "2026-09-28", "10:00", 10.0, None),
        ("h8", "22", "2026-09-26", "12:00", 10.06, None),
    ],
)

LINE_SQL = f"""la as (select *, {D.unit('unit')} as u, greatest(0.0, coalesce(discount, 0.0))::double as dis, floor(quantity * unit_price * 100 + 0.5) / 100 as gross from l),
lb as (select *, floor((gross - dis) * 100 + 0.5) / 100 as net, gross is not null and total is not null as both_ from la),
lc as (select *, floor((total - net) * 100 + 0.5) / 100 as nd, floor((total - gross) * 100 + 0.5) / 100 as gd, u in ({', '.join(map(D.q, UNITS))}) as known from lb),
ld as (select *, both_ and dis > 0 and abs(nd) <= 0.03 as is_net, both_ and abs(gd) <= 0.03 as is_gross,
 coalesce(both_ and ((dis > 0 and abs(total - (gross - dis)) <= 0.03) or abs(total - gross) <= 0.03), false) as arithmetic, coalesce(dis <= gross + 0.03, false) as fair,
 array_to_string([x for x in [case when length(trim(coalesce(name, ''))) < 2 then 'nome' end, case when not coalesce(quantity > 0, false) then 'quantidade' end, case when not known then 'unidade' end, case when not coalesce(unit_price >= 0, false) then 'preço unitário' end, case when not coalesce(total >= 0, false) then 'total da linha' end] if x is not null], ', ') as missing from lc),
audited as (select *, case when is_net then 'NET_AFTER_DISCOUNT' when is_gross and dis > 0 then 'GROSS_BEFORE_DISCOUNT' when is_gross then 'GROSS_EQ_NET' else 'UNRESOLVED' end as basis,
 case when both_ then net end as expected_net, case when both_ and not is_net and is_gross then gd when both_ then nd end as delta,
 case when missing <> '' or not arithmetic or not fair or not known then 'BLOCK' else 'PASS' end as status from ld)"""
DRIVER_LINES = "select cast(purchase_id as varchar) as receipt_id, cast(line_number as varchar) as line_id, cast(product_id as varchar) as barcode, 'item' as name, quantity, 'un' as unit, cast(unit_price_e4 as double) / 10000 as unit_price, cast(line_cents as double) / 100 as total, cast(discount_cents as double) / 100 as discount, 'EXACT' as match_status, 0.9::double as confidence from items"


def driver_lines(m: Model) -> DataFrame:
    """The driver's line items as receipt lines."""
    return m.items.select(F.col("purchase_id").cast("string").alias("receipt_id"), F.col("line_number").cast("string").alias("line_id"), F.col("product_id").cast("string").alias("barcode"), F.lit("item").alias("name"), "quantity", F.lit("un").alias("unit"), (F.col("unit_price_e4").cast("double") / 10000).alias("unit_price"), (F.col("line_cents").cast("double") / 100).alias("total"), (F.col("discount_cents").cast("double") / 100).alias("discount"), F.lit("EXACT").alias("match_status"), F.lit(0.9).alias("confidence"))


@query("audit_lines", f"with {CTES}, {LINES.cte('f')}, l as (select * from f union all {DRIVER_LINES}), {LINE_SQL} select receipt_id, line_id, barcode, gross, expected_net, delta, basis, missing, status, u in ('kg', 'g', 'l', 'ml') as weighted from audited")
def audit_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = LINES.df(spark).unionByName(driver_lines(Model(spark, sf_dir)))
    return audit_lines(lines).select("receipt_id", "line_id", "barcode", "gross", "expected_net", "delta", "basis", F.array_join("missing", ", ").alias("missing"), "status", "weighted")


def receipt_math(audited: DataFrame) -> DataFrame:
    """Sums of a receipt's audited lines, in cents, and how many passed."""
    passed = F.col("status") == "PASS"
    return audited.groupBy("receipt_id").agg(
        F.coalesce(F.sum(cents(F.col("gross"))), F.lit(0)).alias("gross_c"),
        F.sum(cents(F.col("discount"))).alias("discount_c"),
        F.coalesce(F.sum(cents(F.col("expected_net"))), F.lit(0)).alias("net_c"),
        F.count("*").alias("lines"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("blocked"),
        F.bool_and(passed).alias("all_pass"),
        F.count_if(F.col("match_status").isin("AMBIGUOUS", "REVIEW", "WEAK")).alias("doubtful"),
        F.count_if(F.size("missing") > 0).alias("incomplete"),
    )


MATH_SQL = """math as (select receipt_id, coalesce(sum(cast(floor(gross * 100 + 0.5) as bigint)), 0)::bigint as gross_c, sum(cast(floor(dis * 100 + 0.5) as bigint))::bigint as discount_c, coalesce(sum(cast(floor(expected_net * 100 + 0.5) as bigint)), 0)::bigint as net_c,
 count(*) as lines, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'BLOCK') as blocked, bool_and(status = 'PASS') as all_pass, count(*) filter (match_status in ('AMBIGUOUS', 'REVIEW', 'WEAK')) as doubtful, count(*) filter (missing <> '') as incomplete from audited group by 1)"""


@query("receipt_math", f"with {CTES}, {LINES.cte('f')}, l as (select * from f union all {DRIVER_LINES}), {LINE_SQL}, {MATH_SQL} select receipt_id, gross_c / 100.0::double as gross, discount_c / 100.0::double as line_discount, net_c / 100.0::double as net, lines, passed, blocked, all_pass from math")
def receipt_math_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = receipt_math(audit_lines(LINES.df(spark).unionByName(driver_lines(Model(spark, sf_dir)))))
    money = lambda c: F.col(c).cast("double") / 100
    return m.select("receipt_id", money("gross_c").alias("gross"), money("discount_c").alias("line_discount"), money("net_c").alias("net"), "lines", "passed", "blocked", "all_pass")


def duplicate_levels(receipts: DataFrame, history: DataFrame) -> DataFrame:
    """receipt_id and level of receipts that history may hold: by fiscal key, else by tax number, date and total.

    Both lookups are equi-joins; the total's band is a condition on the few rows of one market and day.
    """
    key = lambda c: F.when(F.length(S.digits(F.col(c))) == 44, S.digits(F.col(c)))
    r = receipts.select("receipt_id", key("fiscal_key").alias("k"), S.digits(F.col("cnpj")).alias("c"), "date", F.substring(S.blank(F.col("time")), 1, 8).alias("t"), S.round2(F.coalesce("total", F.lit(0.0))).alias("total"))
    h = history.select(key("fiscal_key").alias("k"), S.digits(F.col("cnpj")).alias("c"), "date", F.substring(S.blank(F.col("time")), 1, 8).alias("ht"), F.coalesce("total", F.lit(0.0)).alias("h_total"))
    exact = r.where(F.col("k").isNotNull()).join(h.select("k").distinct(), "k", "left_semi").select("receipt_id", F.lit("EXACT").alias("level"))
    near = r.where(F.col("k").isNull() & (F.col("c") != "")).drop("k").join(h.drop("k"), ["c", "date"]).where(F.abs(F.col("h_total") - F.col("total")) <= DOCUMENT_TOLERANCE)
    level = F.when(F.bool_or(F.col("ht") == F.col("t")), "HIGH").when(F.count("*") == 1, "MEDIUM").otherwise("REVIEW")
    return exact.unionByName(near.groupBy("receipt_id").agg(level.alias("level")))


DUPLICATE_SQL = f"""dr as (select receipt_id, {D.digits('fiscal_key')} as k, {D.digits('cnpj')} as c, date, substr(coalesce(time, ''), 1, 8) as t, floor(coalesce(total, 0) * 100 + 0.5) / 100 as total from r),
dh as (select {D.digits('fiscal_key')} as k, {D.digits('cnpj')} as c, date, substr(coalesce(time, ''), 1, 8) as t, coalesce(total, 0) as total from h),
dups as (select receipt_id, 'EXACT' as level from dr where length(k) = 44 and k in (select k from dh)
 union all select receipt_id, case when bool_or(dh.t = dr.t) then 'HIGH' when count(*) = 1 then 'MEDIUM' else 'REVIEW' end from dr join dh on dr.c = dh.c and dr.date = dh.date and abs(dh.total - dr.total) <= 0.05 where length(dr.k) <> 44 and dr.c <> '' group by 1)"""


def codes(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules)))


def audit_receipts(receipts: DataFrame, audited: DataFrame, history: DataFrame) -> DataFrame:
    """Sums, variance, issues, warnings and decision of each receipt."""
    x = receipts.join(receipt_math(audited), "receipt_id", "left").join(duplicate_levels(receipts, history), "receipt_id", "left")
    x = x.fillna(0, ["gross_c", "discount_c", "net_c", "lines", "passed", "blocked", "doubtful", "incomplete"]).withColumn("declared", F.coalesce("declared", F.lit(0)))
    known = cents(F.greatest(F.lit(0.0), F.coalesce("discount_total", F.lit(0.0))))
    x = x.withColumn("known_c", known).withColumn("receipt_discount_c", F.greatest(F.lit(0), known - F.col("discount_c")))
    x = x.withColumn("surcharge_c", cents(F.greatest(F.lit(0.0), F.coalesce("surcharge", F.lit(0.0)))))
    x = x.withColumn("expected_c", F.col("gross_c") - F.col("discount_c") - F.col("receipt_discount_c") + F.col("surcharge_c")).withColumn("delta_c", cents(F.col("total")) - F.col("expected_c"))
    counted = (F.col("declared") == 0) | (F.col("declared") == F.col("lines"))
    off = F.abs("delta_c") > 5
    x = x.withColumn("balanced", F.coalesce(~off & F.coalesce("all_pass", F.lit(True)) & counted, F.lit(False)))
    cash = S.normalize_receipt(F.col("method")).rlike("dinheiro|cash") & F.col("change").isNotNull()
    pays = F.when(cash, F.abs(cents(F.col("paid") - F.col("change")) - cents(F.col("total"))) > 5).otherwise(F.abs(cents(F.col("paid")) - cents(F.col("total"))) > 5)
    strong = F.col("level").isin("EXACT", "HIGH")
    header_missing = (F.trim(S.blank(F.col("market"))) == "") | (F.trim(S.blank(F.col("date"))) == "") | F.col("total").isNull()
    issues = codes(
        ("NO_LINES", F.col("lines") == 0), ("LINE_BLOCKED", F.col("blocked") > 0), ("DECLARED_COUNT", ~counted), ("TOTAL_MISSING", F.col("total").isNull() | (F.col("total") <= 0)), ("DISCOUNT_EXCESS", F.col("known_c") > F.col("gross_c") + 5),
        ("TOTAL_LESS", off & (F.col("delta_c") < 0)), ("TOTAL_MORE", off & (F.col("delta_c") > 0)), ("PAYMENT", pays), ("DUPLICATE", strong), ("EVIDENCE_MISSING", header_missing | (F.col("incomplete") > 0)),
    )
    warnings = codes(("DUPLICATE_REVIEW", F.col("level").isNotNull() & ~strong), ("CATALOG_REVIEW", F.col("doubtful") > 0))
    x = x.withColumn("issues", issues).withColumn("warnings", warnings)
    x = x.withColumn("status", F.when(F.size("issues") > 0, "BLOCK").when(F.size("warnings") > 0, "REVIEW").otherwise("PASS"))
    x = x.withColumn("variance", F.when(off & (F.col("delta_c") < 0), "POSSIBLE_DISCOUNT_OR_ERROR").when(off, "POSSIBLE_OVERCHARGE_OR_MISSING_SURCHARGE").otherwise("BALANCED"))
    return x.withColumn("can_publish", F.col("status") == "PASS").withColumn("can_auto_launch", (F.col("status") == "PASS") & F.col("level").isNull())


AUDIT_SQL = f"""{MATH_SQL}, {DUPLICATE_SQL},
ra as (select r.*, coalesce(gross_c, 0) as gc, coalesce(discount_c, 0) as dc, coalesce(lines, 0) as n, coalesce(blocked, 0) as nb, coalesce(doubtful, 0) as nd, coalesce(incomplete, 0) as ni, coalesce(all_pass, true) as ap, coalesce(r.declared, 0) as de, level,
 cast(floor(greatest(0.0, coalesce(discount_total, 0.0)) * 100 + 0.5) as bigint) as kc, cast(floor(greatest(0.0, coalesce(surcharge, 0.0)) * 100 + 0.5) as bigint) as sc, cast(floor(r.total * 100 + 0.5) as bigint) as tc from r left join math using (receipt_id) left join dups using (receipt_id)),
rb as (select *, gc - dc - greatest(0, kc - dc) + sc as ec, tc - (gc - dc - greatest(0, kc - dc) + sc) as xc, de = 0 or de = n as counted,
 coalesce(case when regexp_matches({D.norm_receipt('method')}, 'dinheiro|cash') and change is not null then abs(cast(floor((paid - change) * 100 + 0.5) as bigint) - tc) > 5 else abs(cast(floor(paid * 100 + 0.5) as bigint) - tc) > 5 end, false) as pays from ra),
rc as (select *, array_to_string([x for x in [case when n = 0 then 'NO_LINES' end, case when nb > 0 then 'LINE_BLOCKED' end, case when not counted then 'DECLARED_COUNT' end, case when total is null or total <= 0 then 'TOTAL_MISSING' end, case when kc > gc + 5 then 'DISCOUNT_EXCESS' end,
 case when xc < -5 then 'TOTAL_LESS' end, case when xc > 5 then 'TOTAL_MORE' end, case when pays then 'PAYMENT' end, case when level in ('EXACT', 'HIGH') then 'DUPLICATE' end, case when trim(coalesce(market, '')) = '' or trim(coalesce(date, '')) = '' or total is null or ni > 0 then 'EVIDENCE_MISSING' end] if x is not null], ',') as issues,
 array_to_string([x for x in [case when level in ('MEDIUM', 'REVIEW') then 'DUPLICATE_REVIEW' end, case when nd > 0 then 'CATALOG_REVIEW' end] if x is not null], ',') as warnings from rb),
receipts_audited as (select *, case when issues <> '' then 'BLOCK' when warnings <> '' then 'REVIEW' else 'PASS' end as status from rc)"""


def field_status(present: Column, conflicts: Column, confidence: Column) -> Column:
    return F.when(~present, "MISSING").when(conflicts > 0, "CONFLICT").when(confidence >= 0.8, "CONFIRMED").when(confidence >= 0.55, "INFERRED").otherwise("UNCERTAIN")


STATUS_SQL = "case when trim(coalesce(v, '')) = '' then 'MISSING' when conflicts > 0 then 'CONFLICT' when c >= 0.8 then 'CONFIRMED' when c >= 0.55 then 'INFERRED' else 'UNCERTAIN' end"


@query("field_evidence", f"with e as (select event_id, event_type as v, value / 100.0 as c, case when event_type = 'error' then 1 else 0 end as conflicts from events) select event_id, {STATUS_SQL} as status, greatest(0.0, least(1.0, c))::double as confidence from e")
def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Model(spark, sf_dir).table("events")
    c = F.col("value") / 100.0
    return e.select("event_id", field_status(F.trim(S.blank(F.col("event_type"))) != "", F.when(F.col("event_type") == "error", 1).otherwise(0), c).alias("status"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"))


LINE_VALUES = ["name", "barcode", "quantity", "unit", "unit_price", "total", "discount"]


ALL_LINES = f"{CTES}, {LINES.cte('lf')}, l as (select * from lf union all by name {DRIVER_LINES})"


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the fixtures and of the tables."""
    return LINES.df(spark).unionByName(driver_lines(Model(spark, sf_dir)))


@query("evidence_coverage", f"with {ALL_LINES} select receipt_id, floor(cast(sum(" + " + ".join(f"case when trim(coalesce(cast({c} as varchar), '')) = '' then 0 else 1 end" for c in LINE_VALUES) + f") as double) / (count(*) * {len(LINE_VALUES)}) * 10000 + 0.5) / 10000 as coverage from l group by 1")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = reduce(lambda a, b: a + b, (F.when(F.trim(S.blank(F.col(c))) != "", 1).otherwise(0) for c in LINE_VALUES))
    return all_lines(spark, sf_dir).groupBy("receipt_id").agg((F.floor(F.sum(there).cast("double") / (F.count("*") * len(LINE_VALUES)) * 10000 + 0.5) / 10000).alias("coverage"))


PARSED = Extended(
    "id long, market string, cnpj string, date string, items int, priced int, bad int, declared int, total double, line_sum double, passes int, confidence double, coverage double, needs_review boolean, audit string, publish boolean",
    [
        (1, "Loja", "17833301002223", "2026-09-10", 5, 5, 0, 5, 95.51, 95.51, 4, 0.95, 0.9, False, "PASS", True),
        (2, "Loja", None, "2026-09-10", 5, 4, 1, 6, 95.51, 95.0, 4, 0.95, 0.9, False, "BLOCK", False),
        (3, "Mercado não identificado", "17893301002223", None, 0, 0, 0, 0, 0.0, 0.0, 1, 0.3, 0.1, True, None, None),
        (4, "Loja", "17893301002223", "2026-09-10", 2, 2, 0, 0, 10.0, 10.06, 2, 0.84, 0.82, None, "PASS", True),
        (5, "Loja", "09653290000147", "2026-09-10", 2, 2, 0, 2, 10.0, 10.05, 3, 0.84, 0.82, False, "REVIEW", False),
        (6, "Loja", "09653290000147", "2026-09-10", 2, 2, 0, 2, None, 10.0, 3, 0.83, 0.82, False, "PASS", True),
        (7, "Loja", "09653290000147", "2026-09-10", 2, 2, 0, 2, 10.0, 10.0, 3, 0.9, 0.9, False, "PASS", False),
    ],
    "select o_orderkey + 1000000 as id, case when o_orderkey % 13 = 0 then 'Mercado não identificado' else 'Loja ' || o_custkey end as market, case when o_custkey % 4 = 0 then null when o_custkey % 4 = 1 then '17833301002223' else lpad(cast(o_custkey as varchar(20)), 14, '0') end as cnpj, case when o_orderkey % 17 = 0 then null else cast(cast(o_orderdate as date) as varchar(20)) end as date, o_orderkey % 7 as items, o_orderkey % 5 as priced, case when o_orderkey % 11 = 0 then 1 else 0 end as bad, o_orderkey % 8 as declared, case when o_orderkey % 19 = 0 then null else o_totalprice end as total, o_totalprice + (o_orderkey % 3) * 0.04e0 as line_sum, o_orderkey % 6 as passes, (o_orderkey % 100) / 1e2 as confidence, (o_orderkey % 90) / 1e2 + 0.1e0 as coverage, o_orderkey % 9 = 0 as needs_review, case o_orderkey % 4 when 0 then 'PASS' when 1 then 'PASS' when 2 then 'BLOCK' end as audit, o_orderkey % 10 > 1 as publish from {orders}",
)


def score(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


@query("parse_confidence", f"with {PARSED.cte('t')} select id, floor(least(1.0::double, 0.05::double + case when items > 0 then 0.40::double else 0 end + case when coalesce(total, 0) <> 0 then 0.15::double else 0 end + case when coalesce(cnpj, '') <> '' then 0.15::double else 0 end + case when coalesce(date, '') <> '' then 0.1::double else 0 end + case when declared > 0 and declared = items then 0.1::double else 0 end + case when coalesce(total, 0) <> 0 and abs(line_sum - total) <= 0.05 then 0.1::double else 0 end) * 10000 + 0.5) / 10000 as confidence from t")
def parse_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.coalesce("total", F.lit(0.0))
    parts = [(F.col("items") > 0, 0.40), (total != 0, 0.15), (S.blank(F.col("cnpj")) != "", 0.15), (S.blank(F.col("date")) != "", 0.1), ((F.col("declared") > 0) & (F.col("declared") == F.col("items")), 0.1), ((total != 0) & (F.abs(F.col("line_sum") - total) <= 0.05), 0.1)]
    value = reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0.0), parts, F.lit(0.05))
    return PARSED.df(spark, sf_dir).select("id", score(F.least(F.lit(1.0), value)).alias("confidence"))


@query("structural_score", f"with {PARSED.cte('t')} select id, floor((items * 4 + case when coalesce(market, '') not in ('', 'Mercado não identificado') then 4 else 0 end + case when coalesce(cnpj, '') <> '' then 6 else 0 end + case when coalesce(date, '') <> '' then 4 else 0 end + case when coalesce(total, 0) > 0 then 5 + greatest(0, 8 - least(8, abs(line_sum - total) * 2)) else 0 end + priced * 1.5::double) * 10000 + 0.5) / 10000 as score from t")
def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    total = F.coalesce("total", F.lit(0.0))
    near = F.when(total > 0, 5 + F.greatest(F.lit(0.0), 8 - F.least(F.lit(8.0), F.abs(F.col("line_sum") - total) * 2))).otherwise(0.0)
    value = F.col("items") * 4 + flag(~S.blank(F.col("market")).isin("", "Mercado não identificado"), 4) + flag(S.blank(F.col("cnpj")) != "", 6) + flag(S.blank(F.col("date")) != "", 4) + near + F.col("priced") * 1.5
    return PARSED.df(spark, sf_dir).select("id", score(value).alias("score"))


@query("ocr_escalation", f"with {PARSED.cte('t')} select id, items = 0 or coalesce(total, 0) <= 0 or coalesce(cnpj, '') = '' or coalesce(date, '') = '' or (declared > 0 and declared <> items) or bad > 0 or abs(line_sum - total) > 0.05 or passes < 3 or confidence < 0.84 or coverage < 0.82 or coalesce(needs_review, false) as escalate from t")
def ocr_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.expr("items = 0 or coalesce(total, 0D) <= 0 or coalesce(cnpj, '') = '' or coalesce(date, '') = '' or (declared > 0 and declared <> items) or bad > 0 or abs(line_sum - total) > 0.05D or passes < 3 or confidence < 0.84D or coverage < 0.82D or coalesce(needs_review, false)")
    return PARSED.df(spark, sf_dir).select("id", rule.alias("escalate"))


@query("publish_gate", f"with {PARSED.cte('t')} select id, case when items = 0 then 'NO_ITEMS' when audit is null then 'NOT_AUDITED' when audit <> 'PASS' then 'NOT_PASSED' when not coalesce(publish, false) then 'NOT_PUBLISHABLE' when coalesce(total, 0) <= 0 then 'NO_TOTAL' when coalesce(cnpj, '') <> '' and not ({D.cnpj_valid('cnpj')}) then 'BAD_CNPJ' else 'OK' end as gate from t")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.when(F.col("items") == 0, "NO_ITEMS").when(F.col("audit").isNull(), "NOT_AUDITED").when(F.col("audit") != "PASS", "NOT_PASSED").when(~F.coalesce("publish", F.lit(False)), "NOT_PUBLISHABLE")
    gate = gate.when(F.coalesce("total", F.lit(0.0)) <= 0, "NO_TOTAL").when((S.blank(F.col("cnpj")) != "") & ~S.cnpj_valid(F.col("cnpj")), "BAD_CNPJ").otherwise("OK")
    return PARSED.df(spark, sf_dir).select("id", gate.alias("gate"))


@query("match_status_counts", f"with {ALL_LINES} select receipt_id, " + ", ".join(f"count(*) filter (match_status = '{s}') as {s.lower()}" for s in ("EXACT", "STRONG", "REVIEW", "WEAK", "NEW", "AMBIGUOUS", "MANUAL")) + " from l group by 1")
def match_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("EXACT", "STRONG", "REVIEW", "WEAK", "NEW", "AMBIGUOUS", "MANUAL")
    return all_lines(spark, sf_dir).groupBy("receipt_id").agg(*(F.count_if(F.col("match_status") == s).alias(s.lower()) for s in kinds))
