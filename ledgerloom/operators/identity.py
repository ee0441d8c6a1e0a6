"""Which receipt is which: fingerprints, what a new purchase repeats, and the evidence of a receipt's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import duck as D
from ..plans.model import CTES, Model
from ..plans.registry import query
from .audit import AUDIT_SQL, DUPLICATE_SQL, HEADERS, HISTORY, LINE_SQL, LINES, STATUS_SQL, audit_lines, audit_receipts, duplicate_levels, field_status
from .receipts import COPIES, HEADER_SQL, OBSERVED, observed_lines, receipt_headers

W = f"with {CTES}"


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimals, null as 0."""
    return F.coalesce(c, F.lit(0)).cast(f"decimal(18,{places})").cast("string")


def formatted_cnpj(c: Column) -> Column:
    d = S.digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise("")


def signature(parts: list[Column], apart: str) -> Column:
    """The sorted texts of a receipt's lines."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *parts))), apart)


def fingerprints(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with their fingerprint (by all that is printed), context (by what the auditor compares) and coarse key (market's number, date, total).

    A receipt with a fiscal key of 44 digits has that key in place of the first two. Missing texts are empty, missing numbers 0; a receipt without
    lines has an empty signature; the order of lines doesn't count.
    """
    f = F.col
    amounts = [fixed(f("quantity"), 3), fixed(f("unit_price"), 4), fixed(f("total"), 2)]
    printed = [S.digits(f("barcode")), S.normalize(f("name")), S.normalize(f("unit")), *amounts]
    compared = [S.digits(f("barcode")), S.normalize_receipt(f("name")), S.canonical_unit(f("unit")), *amounts, fixed(f("discount"), 2)]
    sums = lines.groupBy("receipt_id").agg(signature(printed, "||").alias("printed"), signature(compared, "~").alias("compared"))
    x = headers.join(sums, "receipt_id", "left")
    key, time, total = S.digits(f("fiscal_key")), F.substring(S.blank(f("time")), 1, 8), fixed(f("total"), 2)
    upper = lambda c: F.upper(F.trim(S.blank(f(c))))
    whole = F.concat_ws("##", formatted_cnpj(f("cnpj")), upper("market"), S.blank(f("date")), time, upper("document"), total, S.blank(f("printed")))
    context = F.concat_ws("|", S.digits(f("cnpj")), S.blank(f("date")), time, total, S.blank(f("compared")))
    by_key = F.length(key) == 44
    return x.withColumns({
        "fingerprint": F.when(by_key, F.concat(F.lit("FISCAL:"), key)).otherwise(F.sha2(whole, 256)),
        "context": F.when(by_key, key).otherwise(F.sha2(context, 256)),
        "coarse": F.when(by_key, F.lit(None)).otherwise(F.concat_ws("|", S.digits(f("cnpj")), S.blank(f("date")), total)),
    }).drop("printed", "compared")


def first_repeats(purchases: DataFrame) -> DataFrame:
    """purchase_id and the first active purchase before it that it repeats: by fingerprint, else by date, hour and minute, total and
    either the market's number or the document's. Groups are aggregated, so a hot market or day meets no single task.
    """
    x = purchases.withColumns({"hour": F.substring(S.blank(F.col("time")), 1, 5), "own_cnpj": formatted_cnpj(F.col("cnpj")), "own_document": S.blank(F.col("document"))})
    moment = ["date", "hour", "total"]

    def first(keys: list[str], name: str) -> DataFrame:
        return x.where("active").where(F.col(keys[-1]) != "").groupBy(*keys).agg(F.min("purchase_id").alias(name))

    x = x.join(first(["fingerprint"], "same"), "fingerprint", "left")
    x = x.join(first([*moment, "own_cnpj"], "by_cnpj"), [*moment, "own_cnpj"], "left").join(first([*moment, "own_document"], "by_document"), [*moment, "own_document"], "left")
    before = lambda c: F.when(F.col(c) < F.col("purchase_id"), F.col(c))
    existing = F.coalesce(before("same"), F.least(before("by_cnpj"), before("by_document")))
    return x.select("purchase_id", existing.alias("existing")).where("existing is not null")


#: Orders as receipts, and copies of every fiftieth that differ in one thing or nothing; v tells in what. For both engines.
DOCUMENTS = f"""select purchase_id, purchase_id as k, c_name as market, lpad(cast(market_id as varchar(20)), 14, '0') as cnpj, cast(purchase_date as varchar(20)) as date, '10:00:00' as time, 'd' || purchase_id as document, total_cents, active, -1 as v from purchases join customer on c_custkey = market_id
union all select purchase_id + {COPIES}, purchase_id, c_name || case when purchase_id % 300 = 50 then ' x' else '' end, case when purchase_id % 350 = 0 then '' else lpad(cast(market_id as varchar(20)), 14, '0') end, cast(purchase_date as varchar(20)), case when purchase_id % 300 = 100 then '10:00:59' when purchase_id % 300 = 250 then '10:01' else '10:00:00' end,
 case when purchase_id % 300 = 150 then 'z' else 'd' end || purchase_id, total_cents + case when purchase_id % 300 = 200 then 1 else 0 end, active, cast(purchase_id % 300 as int) from purchases join customer on c_custkey = market_id where purchase_id % 50 = 0"""


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Headers and lines of orders and their copies; copies with v 0 have another unit price in each line."""
    m = Model(spark, sf_dir)
    text = DOCUMENTS.replace("from purchases join customer", "from {purchases} join {customer}")
    heads = spark.sql(text, purchases=m.purchases, customer=m.table("customer"))
    heads = heads.select(F.col("purchase_id").alias("receipt_id"), "*", (F.col("total_cents").cast("double") / 100).alias("total"), F.lit(None).cast("string").alias("fiscal_key"))
    own = observed_lines(m).withColumn("receipt_id", F.col("receipt_id").cast("long"))
    lines = heads.select(F.col("receipt_id").alias("id"), "k", "v").join(own, F.col("k") == F.col("receipt_id")).drop("receipt_id").withColumnRenamed("id", "receipt_id")
    return heads, lines.withColumn("unit_price", F.col("unit_price") + F.when(F.col("v") == 0, 0.5).otherwise(0.0))


def _line(normal: str, unit: str, more: str = "") -> str:
    return f"'' || '|' || {normal} || '|' || {unit} || '|' || cast(cast(quantity as decimal(18,3)) as varchar) || '|' || cast(cast(unit_price_e4::double / 10000 + case when v = 0 then 0.5 else 0 end as decimal(18,4)) as varchar) || '|' || cast(cast(line_cents::double / 100 as decimal(18,2)) as varchar){more}"


_TOTAL = "cast(cast(total_cents::double / 100 as decimal(18,2)) as varchar)"
DOCUMENT_SQL = f"""dd as ({DOCUMENTS}),
ol as (select i.purchase_id as k, {OBSERVED.replace('product_id', 'i.product_id')} as name, i.quantity, i.unit_price_e4, i.line_cents from items i join products p using (product_id)),
dl as (select dd.purchase_id, v, ol.* from dd join ol using (k)),
ds as (select purchase_id, string_agg(a, '||' order by a) as printed, string_agg(b, '~' order by b) as compared from (select purchase_id, {_line(D.norm('name'), "'un'")} as a, {_line(D.norm_receipt('name'), "'un'", " || '|0.00'")} as b from dl) group by 1),
df as (select dd.*, sha256({D.cnpj('cnpj')} || '##' || upper(trim(market)) || '##' || date || '##' || time || '##' || upper(document) || '##' || {_TOTAL} || '##' || coalesce(printed, '')) as fingerprint,
 sha256(cnpj || '|' || date || '|' || time || '|' || {_TOTAL} || '|' || coalesce(compared, '')) as context, cnpj || '|' || date || '|' || {_TOTAL} as coarse from dd left join ds using (purchase_id))"""


@query("receipt_fingerprint", f"{W}, {DOCUMENT_SQL} select purchase_id as receipt_id, fingerprint, context, coarse from df")
def receipt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, context and coarse key of all orders and their copies."""
    return fingerprints(*documents(spark, sf_dir)).select("receipt_id", "fingerprint", "context", "coarse")


@query("save_time_duplicate", f"{W}, {DOCUMENT_SQL}, same as (select a.purchase_id, min(b.purchase_id) as e from df a join df b on a.fingerprint = b.fingerprint and b.purchase_id < a.purchase_id where b.active group by 1), near as (select a.purchase_id, min(b.purchase_id) as e from df a join df b on a.date = b.date and substr(a.time, 1, 5) = substr(b.time, 1, 5) and a.total_cents = b.total_cents and b.purchase_id < a.purchase_id where b.active and ((a.cnpj <> '' and a.cnpj = b.cnpj) or a.document = b.document) group by 1) select purchase_id, coalesce(same.e, near.e) as existing from df left join same using (purchase_id) left join near using (purchase_id) where coalesce(same.e, near.e) is not null")
def save_time_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first active purchase that a purchase would repeat when it is saved."""
    return first_repeats(fingerprints(*documents(spark, sf_dir)))


#: Fields of a receipt's evidence: name, whether it's required, and its value in both engines.
EVIDENCE = [("marketName", True, "market"), ("cnpj", False, "cnpj"), ("date", True, "date"), ("time", False, "time"), ("documentNumber", False, "document"), ("fiscalKey", False, "fiscal_key"), ("total", True, "total"), ("discountTotal", False, "coalesce(discount_total, 0)"), ("paymentMethod", False, "method"), ("paymentAmount", False, "paid"), ("declaredItemCount", False, "declared"), ("auditMath", True, "balanced")]
#: A document's number, a fiscal key and a decoded QR code for the receipts that have none in the tables, in both engines.
EXTRAS = "case when length(receipt_id) % 2 = 0 then 'D' || receipt_id else ' ' end as document, case when fiscal_key is null and receipt_id like '%7' then lpad(receipt_id, 44, '1') else fiscal_key end as fiscal_key, receipt_id like '%17' as qr"


def evidence(audited: DataFrame) -> DataFrame:
    """receipt_id, field, required, status, source and confidence of the twelve fields of each audited receipt.

    A missing discount is one of 0. A key read from a QR code has that source and a confidence of .99; whether the receipt's
    sums agree is the auditor's own finding, sure or not at all.
    """
    fields = [F.struct(F.lit(f).alias("field"), F.lit(need).alias("required"), F.expr(v).cast("string").alias("value")) for f, need, v in EVIDENCE]
    x = audited.withColumn("source", F.replace(S.normalize_receipt(F.col("source")), F.lit(" "), F.lit("_"))).select("receipt_id", "source", "confidence", "qr", "balanced", F.explode(F.array(*fields)).alias("f"))
    by_qr, sums = (F.col("f.field") == "fiscalKey") & F.col("qr"), F.col("f.field") == "auditMath"
    sure = F.when(by_qr, 0.99).when(sums, F.when(F.col("balanced"), 1.0).otherwise(0.0)).otherwise(F.coalesce("confidence", F.lit(0.0)))
    source = F.when(by_qr, "qr").when(sums, "auditor").otherwise(F.col("source"))
    return x.select("receipt_id", "f.field", "f.required", field_status(F.trim(S.blank(F.col("f.value"))) != "", F.lit(0), sure).alias("status"), source.alias("source"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"))


_ORDERS = HEADER_SQL.replace("r as (select cast(p.", "ro as (select cast(p.").replace("from r where", "from ro where").replace("\nh as", "\nho as").replace("\nl as", "\nlo as")
RECEIPTS_SQL = f"""{W}, ol as (select i.purchase_id, i.line_number, i.product_id, {OBSERVED.replace('product_id', 'i.product_id')} as name, i.quantity, i.unit_price_e4, i.line_cents from items i join products p using (product_id)), decided as (select distinct name, 'EXACT' as match_status from ol),
{_ORDERS}, {LINES.cte('lf')}, {HEADERS.cte('rf')}, {HISTORY.cte('hf')}, r as (select * from rf union all by name select * from ro), l as (select * from lf union all by name select * from lo), h as (select * from hf union all by name select * from ho)"""
EVIDENCE_SQL = f"""{RECEIPTS_SQL},
{LINE_SQL}, {AUDIT_SQL}, ba as (select * exclude (fiscal_key), {EXTRAS}, coalesce(abs(xc) <= 5 and ap and counted, false) as balanced from receipts_audited),
ev as ({' union all '.join(f"select receipt_id, '{f}' as field, {str(need).lower()} as required, cast({v} as varchar) as v, 0 as conflicts, " + ("case when qr then 0.99 else coalesce(confidence, 0.0) end" if f == 'fiscalKey' else "case when balanced then 1.0 else 0.0 end" if f == 'auditMath' else "coalesce(confidence, 0.0)") + "::double as c, " + ("case when qr then 'qr' else " + f"replace({D.norm_receipt('source')}, ' ', '_')" + " end" if f == 'fiscalKey' else "'auditor'" if f == 'auditMath' else f"replace({D.norm_receipt('source')}, ' ', '_')") + " as source from ba" for f, need, v in EVIDENCE)})"""


@query("receipt_evidence", f"{EVIDENCE_SQL} select receipt_id, field, required, {STATUS_SQL} as status, source, greatest(0.0, least(1.0, c))::double as confidence from ev")
def receipt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all receipts."""
    heads, lines, history = all_receipts(spark, sf_dir)
    heads = heads.withColumn("said", F.col("declared"))  # the audit counts what isn't said as 0
    audited = audit_receipts(heads, audit_lines(lines), history).withColumn("declared", F.col("said"))
    extras = spark.sql(f"select * except (fiscal_key), {EXTRAS} from {{x}}", x=audited)
    return evidence(extras.withColumn("balanced", F.coalesce("balanced", F.lit(False))))


def all_receipts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, lines and history of the fixtures and of the orders."""
    m = Model(spark, sf_dir)
    observed = observed_lines(m)
    heads, number = receipt_headers(m, observed), F.col("receipt_id").cast("long")
    history = heads.where(number % 7 == 0).select(F.col("receipt_id").alias("purchase_id"), "cnpj", "date", F.when(number % 2 == 0, "10:00").otherwise("11:00").alias("time"), (F.col("total") + 0.03).alias("total"), "fiscal_key")
    lines = LINES.df(spark)
    lines = lines.unionByName(observed.withColumn("match_status", F.lit("EXACT")).select(lines.columns))
    return HEADERS.df(spark).unionByName(heads), lines, HISTORY.df(spark).unionByName(history)


@query("duplicate_levels", f"{RECEIPTS_SQL}, {DUPLICATE_SQL} select receipt_id, level from dups")
def duplicate_levels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, _, history = all_receipts(spark, sf_dir)
    return duplicate_levels(heads, history)


@query("audit_receipts", f"{RECEIPTS_SQL}, {LINE_SQL}, {AUDIT_SQL} select receipt_id, ec / 100.0::double as expected, xc / 100.0::double as delta, coalesce(abs(xc) <= 5 and ap and counted, false) as balanced, case when xc < -5 then 'POSSIBLE_DISCOUNT_OR_ERROR' when xc > 5 then 'POSSIBLE_OVERCHARGE_OR_MISSING_SURCHARGE' else 'BALANCED' end as variance, issues, warnings, status, status = 'PASS' as can_publish, status = 'PASS' and level is null as can_auto_launch from receipts_audited")
def audit_receipts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, variance, issues, warnings and decision of all receipts."""
    heads, lines, history = all_receipts(spark, sf_dir)
    x = audit_receipts(heads, audit_lines(lines), history)
    return x.select("receipt_id", (F.col("expected_c").cast("double") / 100).alias("expected"), (F.col("delta_c").cast("double") / 100).alias("delta"), "balanced", "variance", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), "status", "can_publish", "can_auto_launch")
